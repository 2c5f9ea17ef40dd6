"""``contains:`` and ``absent:`` claims about a text, joined by ``&&``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAUSE = r"^\s*(contains|absent):\s*(.+?)\s*$"
#: Nested quantifiers, whose search may take exponential time.
NESTED = r"\([^)]*[+*][^)]*\)[+*{]"
#: Word bounds by letters, digits and underscores of ASCII, as ``\w`` has them: what ``\b`` means by itself depends on the JVM.
BOUND, NO_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def bounded(pattern: Column) -> Column:
    """``pattern`` with its word bounds spelled out."""
    for escape, meaning in (("b", BOUND), ("B", NO_BOUND)):
        pattern = F.regexp_replace(pattern, rf"(?<!\\)((?:\\\\)*)\\{escape}", "$1" + meaning.replace("\\", "\\\\"))
    return pattern


def parse(claim: Column) -> Column:
    """array<struct<want boolean, pattern string>>; null if a clause isn't one, is over 500
    characters or nests quantifiers."""
    parts = F.split(claim, r"\s+&&\s+")
    clauses = F.transform(parts, lambda p: F.struct((F.regexp_extract(p, CLAUSE, 1) == "contains").alias("want"), bounded(F.regexp_extract(p, CLAUSE, 2)).alias("pattern")))
    good = F.forall(parts, lambda p: p.rlike(CLAUSE) & (F.length(p) <= 500) & ~p.rlike(NESTED))
    return F.when(good, clauses)


def lines(text: Column, first: Column, count: Column) -> Column:
    """Part of a text by lines, from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, count), "\n")


def verdict(claim: Column, text: Column) -> Column:
    """CONFIRMED, BROKEN, or UNKNOWN without a claim that parses or a text. Patterns are searched for
    as regular expressions in the whole text."""
    clauses = parse(claim)
    holds = F.forall(clauses, lambda c: F.regexp_like(text, c["pattern"]) == c["want"])
    return F.when(clauses.isNull() | text.isNull(), "UNKNOWN").when(holds, "CONFIRMED").otherwise("BROKEN")


def merged(drift: Column, verdict_: Column, scoped: Column) -> Column:
    """One signal from a node's drift and its claim: a broken claim is louder than any drift, a
    confirmed one about the node's own lines makes up for a commit, but not for a missing file."""
    return (
        F.when(drift == "missing", "missing").when(verdict_ == "BROKEN", "broken")
        .when((verdict_ == "CONFIRMED") & scoped & drift.isin("committed", "dirty"), "holds")
        .when((verdict_ == "CONFIRMED") & ~scoped & (drift != "fresh"), "unverified").otherwise(drift)
    )
