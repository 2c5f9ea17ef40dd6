"""Text functions as column expressions: all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import QUERY_STOP, STOP, TAG_ALIASES, TAGS

# What counts as an anchor, and where names are cut.
COMPOUND = r"[a-z][a-z0-9]*(?:[-_.][a-z0-9]+)+"
WORD = r"[a-z][a-z0-9]{3,}"
DOMAIN_ID = r"(?:adr|alpha|migration|chunk|phase|wave)[-\s#]*\d+"
CAMEL = r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def literals(words) -> Column:
    return F.array(*map(F.lit, words))


def anchors(text: Column) -> Column:
    """The distinct anchor terms of a text: compounds, words of four characters that aren't stopped,
    and domain ids. Pieces with a run of over 64 letters and digits are no anchors."""
    low = F.lower(text)
    pieces = F.filter(F.split(low, r"\s+"), lambda p: ~p.rlike("[a-z0-9]{65,}"))
    kept = F.when(low.rlike("[a-z0-9]{65}"), F.array_join(pieces, " ")).otherwise(low)  # few texts need to be cut
    ids = F.transform(F.regexp_extract_all(low, F.lit(DOMAIN_ID), F.lit(0)), lambda m: F.translate(m, " #", ""))
    words = F.array_except(F.regexp_extract_all(kept, F.lit(WORD), F.lit(0)), literals(STOP))
    return F.array_distinct(F.concat(F.regexp_extract_all(kept, F.lit(COMPOUND), F.lit(0)), words, ids))


def query_tokens(text: Column, more_stopped=()) -> Column:
    """Anchor terms of a query, without what queries leave out."""
    return F.array_except(anchors(text), literals([*QUERY_STOP, *more_stopped]))


def clean_anchors(terms: Column) -> Column:
    """Given anchors as search terms: those of one or two words stay, unless stopped, and all give
    their own anchors besides."""
    low = F.transform(F.coalesce(terms, F.expr("cast(array() as array<string>)")), lambda t: F.lower(F.trim(t)))
    short = F.filter(low, lambda t: (F.size(F.split(t, r"\s+")) <= 2) & (t != "") & ~t.isin(STOP))
    return F.array_distinct(F.concat(short, F.flatten(F.transform(low, anchors))))


def canonical_tags(tags: Column) -> Column:
    """Tags lower-cased, aliases resolved, unknown ones left out, in order without repeats."""
    alias = F.create_map(*(F.lit(x) for kv in TAG_ALIASES.items() for x in kv))
    named = F.transform(tags, lambda t: F.coalesce(F.try_element_at(alias, F.lower(F.trim(t))), F.lower(F.trim(t))))
    return F.array_distinct(F.filter(named, lambda t: t.isin(TAGS)))


def stem(token: Column) -> Column:
    """Without one final s, if over three characters and not ss."""
    return F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), token.substr(F.lit(1), F.length(token) - 1)).otherwise(token)


def name_tokens(name: Column) -> Column:
    """Pieces of a symbol in camel, snake or kebab case, stemmed."""
    return F.transform(F.filter(F.split(name, CAMEL), lambda t: t != ""), lambda t: stem(F.lower(t)))


def trigrams(name: Column) -> Column:
    """Distinct runs of three characters of the letters and digits, two spaces before and after."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_key(title: Column) -> Column:
    """Lower case, white space collapsed: titles are the same if this is."""
    return F.regexp_replace(F.lower(F.trim(title)), r"\s+", " ")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def split_headline(title: Column) -> Column:
    """struct<headline, rest>: a title of over 120 characters cut behind the first sentence end that leaves 18 to 240 of
    them; whole, with an empty rest, where it is shorter or has none. Only white space between the two goes."""
    whole = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", "")
    head = F.regexp_extract(whole, r"(?s)^(.{17,239}?[.!?])\s", 1)
    cut = (F.length(whole) > 120) & (head != "")
    rest = F.regexp_replace(whole.substr(F.length(head) + 1, F.length(whole)), r"^\s+", "")
    return F.struct(F.when(cut, head).otherwise(whole).alias("headline"), F.when(cut, rest).otherwise("").alias("rest"))


def headline(title: Column) -> Column:
    """What :func:`split_headline` leaves of a title."""
    return split_headline(title)["headline"]


def tokens_of_chars(chars: Column) -> Column:
    """The estimate of one token for four characters."""
    return F.floor(chars / 4)
