"""HTML extraction: the contiguous region of a page with the greatest score.

Words score by the elements that they are in, tags score negative, by weights learned from labelled
pages; one linear scan finds the best region. Elements inside of it whose weights say that they are no
main text are left out. The marks of the labels are no features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import kept_columns, lean, map_rows, quoted, slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())  # what they hold is no text of the page
#: Elements, and words in class, id and role, that labelled pages need not show: what is known of them
#: beforehand counts like PRIOR words outside main text, beside those that labelled pages show.
DOUBTED = frozenset("aside button canvas dialog fieldset footer form header label menu nav object option select hidden".split())
DOUBTED_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Words that name what holds main text: a name that ends with one is of a place, whatever else is in it.
FAVOURED = frozenset("article body content entry main page post story text".split())
#: Names of what stands above a text, its own heading included.
HEADS = frozenset("banner head header masthead .banner .head .header .masthead".split())
PRIOR = 2000
LABELLED = ("article", "main")
#: Pages that the weights are learned from: of those that mark their main text, those of least hash.
SAMPLE = 500

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<cut>/?[a-zA-Z][^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements that say what part of a page they hold; others, as div, are known by class, id and role only.
CONTAINERS = frozenset("aside button canvas dialog fieldset figure footer form head header label menu nav object option select".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    """What an element is known by, and what it holds."""

    features: frozenset[str] = frozenset()
    favoured: bool = False  # one of its names speaks of main text
    marked: bool = False  # it is in an element that marks main text
    holds_main: bool = False  # such an element is in it
    holds_heading: bool = False

    def known_by(self) -> tuple[str, ...]:
        """Its features as far as they say something of all that is in it: what holds main text is no part of a page beside
        it, and what holds the heading of a text is no head of the page."""
        if self.holds_main:
            return ()
        return tuple(sorted(self.features - HEADS if self.holds_heading and (self.marked or self.favoured) else self.features))


def element(name: str, rest: str) -> Element:
    """By its name if it holds parts of a page, the words of its class, id and role, and "hidden" if its attributes say
    so. No doubted word counts in a name whose last word is FAVOURED."""
    found, favoured = {name} if name in CONTAINERS else set(), False
    if "=" in rest or "hidden" in rest.lower():
        for attribute, value in _ATTRIBUTE.findall(rest):
            attribute, value = attribute.lower(), value.strip("\"'")
            if attribute in ("class", "id", "role"):
                for token in value.split() if name not in ("html", "body") else ():
                    words = [w.lower() for w in _PARTS.findall(token)]
                    favoured |= bool(FAVOURED.intersection(words))
                    place = words and words[-1] in FAVOURED
                    found |= {"." + w for w in words if not (place and w in DOUBTED_NAMES)}
            elif attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true" or attribute == "style" and re.search(r"display\s*:\s*none", value, re.I):
                found.add("hidden")
    return Element(frozenset(found), favoured)


@dataclass
class Piece:
    """A stretch of text in one block, or a tag."""

    kind: str  # "word" or "tag"
    feature: str
    block: int
    text: str = ""
    within: tuple[tuple[str, ...], ...] = ()  # the features of each element around it, the outermost first
    labelled: bool = False


def pieces(html: str) -> list[Piece]:
    """The text and tags of a page in order, each with the elements that it is in; ``labelled``: in
    one that marks main text. Unclosed elements end as a browser would end them; a page may be cut
    off anywhere."""
    out: list[Piece] = []
    around: list[tuple[Element, ...]] = []  # of each piece
    stack: list[tuple[str, tuple[Element, ...], bool]] = []  # name, elements and label, as inherited
    block = 0

    def last(names, stop=()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                return -1
        return -1

    for m in _TOKEN.finditer(html):
        within, marked = (stack[-1][1], stack[-1][2]) if stack else ((), False)
        if m["text"] is not None:
            text = unescape(m["text"])
            link = last(("a",), BLOCKS) >= 0
            at = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "body")
            out.append(Piece("word", f"{'link' if link else 'text'} {at}", block, text, labelled=marked))
            around.append(within)
            continue
        if m["name"] is None:
            if m["raw"] is not None:
                out.append(Piece("tag", m["raw"].lower(), block, labelled=marked))
                around.append(within)
            continue
        name = m["name"].lower()
        known = name if name in BLOCKS or name in INLINE or name in VOID else "other"
        if name in BLOCKS:
            block += 1
        if m["close"]:
            out.append(Piece("tag", known, block, labelled=marked))
            around.append(within)
            if (i := last((name,))) >= 0:
                del stack[i:]
            continue
        if name in BLOCKS:
            # A block ends a paragraph, and some elements end their like.
            if (i := last(("p",), BLOCKS - {"p"})) >= 0:
                del stack[i:]
            if name in ENDS and (i := last(ENDS[name], LISTS)) >= 0:
                del stack[i:]
            within, marked = (stack[-1][1], stack[-1][2]) if stack else ((), False)
        for e in within:
            e.holds_main |= name in LABELLED
            e.holds_heading |= name == "h1"
        own = element(name, m["rest"])
        if own.features:
            own.marked = marked
            within = (*within, own)
        marked = marked or name in LABELLED
        out.append(Piece("tag", known, block, " " if name == "br" else "", labelled=marked))
        around.append(within)
        if name not in VOID and not m["rest"].endswith("/"):
            stack.append((name, within, marked))
        elif name in BLOCKS:
            block += 1
    for piece, elements in zip(out, around):
        piece.within = tuple(known for e in elements if (known := e.known_by()))
    return out


@dataclass
class Weights:
    """Weights of words, by the elements around them and by the block that they are in, and of tags by name."""

    around: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)

    def around_of(self, within: tuple[tuple[str, ...], ...]) -> float:
        """The weights of all elements around a piece together, each by the feature that says most."""
        return sum(max((self.around.get(f, doubt(f)) for f in own), key=abs) for own in within)

    def out(self, piece: Piece) -> bool:
        """Whether the elements around it say that it is no main text, wherever it is."""
        return self.around_of(piece.within) <= -1

    def of(self, piece: Piece) -> float:
        """Of a tag, or of all words of a stretch: each between -1 and 1, by the elements around them and
        their block. In an element that is no main text both cost a little: it may be amid some."""
        n = 1 if piece.kind == "tag" else len(piece.text.split())
        if self.out(piece):
            return -0.1 * n
        if piece.kind == "tag":
            return self.tag.get(piece.feature, -0.5)
        own = self.word.get(piece.feature, -0.25 if piece.feature.startswith("link") else 1.0)
        return n * max(-1.0, min(1.0, self.around_of(piece.within) + own))


def doubt(feature: str) -> float:
    """The weight of a feature that no labelled page shows."""
    return -log(PRIOR + 1) if feature in DOUBTED or feature.startswith(".") and feature[1:] in DOUBTED_NAMES else 0.0


def weights_from(counts: Counter) -> Weights:
    """From how often words and tags are inside and outside marked main text: log odds.

    First those of features of elements, at most 6 either way; what is doubted beforehand has PRIOR words more
    outside, for a few such words in marked text may still be none of it. Then, by what no element explains,
    those of words by their block, between -1 and 1, and those of tags, between -3 and -0.1.
    """
    around: Counter = Counter()
    for (kind, _, within, inside), n in counts.items():
        if kind == "word":
            for f in within.split():
                around[f, inside] += n
    weights = Weights()
    for f in {f for f, _ in around}:
        odds = log((around[f, True] + 1) / (around[f, False] + 1 + (PRIOR if doubt(f) else 0)))
        weights.around[f] = max(-6.0, min(6.0, odds))
    rest: Counter = Counter()
    for (kind, feature, within, inside), n in counts.items():
        if weights.around_of(tuple((f,) for f in within.split())) > -1:
            rest[kind, feature, inside] += n
    for kind, feature in {(k, f) for k, f, _ in rest}:
        odds = log((rest[kind, feature, True] + 1) / (rest[kind, feature, False] + 1))
        if kind == "tag":
            weights.tag[feature] = max(-3.0, min(-0.1, odds))
        else:
            weights.word[feature] = max(-1.0, min(1.0, odds))
    return weights


def feature_counts(html: str) -> Counter:
    """(kind, feature, features around it, inside) of a labelled page: words by their block, tags by name."""
    counts: Counter = Counter()
    for p in pieces(html):
        if n := 1 if p.kind == "tag" else len(p.text.split()):
            counts[p.kind, p.feature, " ".join(sorted({f for own in p.within for f in own})), p.labelled] += n
    return counts


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the greatest sum, the first and shortest of equals; (0, 0) if none
    is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(html: str, weights: Weights) -> str:
    """The blocks of the best region, white space in each turned into one space, joined by two line
    ends; whole blocks, and without the elements in it that are no main text."""
    found = pieces(html)
    a, b = best_region([weights.of(p) for p in found])
    if a == b:
        return ""
    kept = [not weights.out(p) for p in found]
    inside = {p.block for p, k in zip(found[a:b], kept[a:b]) if k and p.kind == "word" and p.text.strip()}
    blocks: dict[int, list[str]] = {}
    for p, k in zip(found, kept):
        if k and p.block in inside and p.text:
            blocks.setdefault(p.block, []).append(p.text)
    return "\n\n".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """From the ``sample`` pages of least hash among those that mark their main text. Their hashes are
    found first, and only those pages are read again; their counts are summed before they reach the
    driver. Without such pages the weights are those known beforehand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(feature_counts(t.as_py()))
        if counts:
            columns = [pa.array(c) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], ["kind", "feature", "within", "inside", "n"])

    at = F.xxhash64(F.col(quoted(id_col)), F.col(quoted(html_col)))
    marked = pages.where(F.lower(html_col).rlike("<(" + "|".join(LABELLED) + r")[\s>]")).select(F.col(html_col).alias("html"), at.alias("at"))
    least = [r.at for r in marked.select("at").distinct().orderBy("at").limit(sample).collect()]
    chosen = marked.where(F.col("at") <= max(least, default=0)).dropDuplicates(["at"])
    by = ["kind", "feature", "within", "inside"]
    rows = chosen.select("html").mapInArrow(lean(run), "kind string, feature string, within string, inside boolean, n long").groupBy(*by).agg(F.sum("n").alias("n")).collect()
    return weights_from(Counter({tuple(r[k] for k in by): r.n for r in rows}))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), weights: Weights | None = None) -> DataFrame:
    """(id, text, then the columns ``keep``): the main text of each row's whole page.

    A null page counts as empty, a page without main text has an empty one; one row for each row,
    repeated ones too, no shuffle but for the weights' sample; an empty table gives none. A kept column called
    ``id`` or ``text`` comes back as ``id_kept`` or ``text_kept``. Without ``weights``, they are learned from ``pages``.
    """
    held = pages.sparkSession.sparkContext.broadcast(weights or learn_weights(pages, id_col, html_col))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(t.as_py(), held.value) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], ["id", "text", *batch.schema.names[2:]])

    kept = pages.select(*kept_columns(keep, ("id", "text")))
    own = pages.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(html_col)), F.lit("")).alias("html"), *kept_columns(keep, ("id", "text")))
    fields = [StructField("id", own.schema[0].dataType), StructField("text", StringType()), *kept.schema.fields]
    return map_rows(own, run, StructType(fields))
