"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

The grammar of each kind of credential is inferred by merging statistically compatible states of
the prefix tree of its labelled strings into a probabilistic automaton; every candidate string is
then scored by its likelihood under these automata against that of plain text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappush, heappushpop
from math import log, sqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, map_rows, quoted, slices

# Kind, pattern, group that is the secret, least length of that group.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = (*(b[0] for b in BASE), "format")
#: Candidates are whole runs of LEAST or more of these characters but "=", which may only end one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST = 12
#: Labelled strings of each kind that the automata are fitted on: those of least hash, of LONGEST or less.
LABELLED = 1000
LONGEST = 256
ROUNDS = 8
#: By how many nats a format must be likelier than plain text.
MARGIN = 12.0

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = bytes(0x78 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_RUN = bytes(0x78 if chr(c) in ALPHABET and chr(c) != "=" else 0x20 for c in range(256))

Span = tuple[int, int, int, int]  # start, number of the kind, end, start of the secret itself


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind; code points, end exclusive."""
    raw = text.encode()
    low = raw.lower()
    possible = (any(k in low for k in _KEYWORDS), b"AKIA" in raw, b"x" * BASE[2][3] in raw.translate(_HEX))
    found = []
    for number, (_, pattern, group, least) in enumerate(BASE):
        if possible[number]:
            found += [(m.start(), number, m.end(), m.start(group)) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


@cache
def _candidates(least: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_.-]{%d,}={0,2}" % least)


def candidates(text: str, least: int = LEAST) -> list[tuple[int, int]]:
    """All candidate runs, whatever else overlaps them."""
    if b"x" * least not in text.encode().translate(_RUN):
        return []
    return [(m.start(), m.end()) for m in _candidates(least).finditer(text)]


def symbol(c: str) -> str:
    """What the automata move by: the class of a letter or digit, any other character itself."""
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c


SYMBOLS = "aA0+/_.=-"
_SIZE = {s: sum(symbol(c) == s for c in ALPHABET) for s in SYMBOLS}


class Automaton:
    """A deterministic probabilistic automaton, fitted by state merging.

    States move by the class of a character, and each has a distribution of the characters of each
    class. Two states are compatible if what they saw differs by less than Hoeffding's bound at
    ``alpha``: how often strings end, move by each class and have each character there, and how long
    what is left of the strings is; and so do all states that they lead to. Of several compatible
    states one is merged with that which it differs least from.
    """

    def __init__(self, strings: Iterable[str], alpha: float = 0.01):
        self.bound = sqrt(0.5 * log(2 / alpha))
        self.n: list[int] = []
        self.next: list[dict[str, int]] = []
        self.seen: list[Counter] = []  # characters, and "" for an end
        self.left: list[Counter] = []  # characters to come
        self._state()
        for s in strings:
            at = 0
            for i, c in enumerate(s):
                self._see(at, c, len(s) - i)
                move = symbol(c)
                if move not in self.next[at]:
                    self.next[at][move] = self._state()
                at = self.next[at][move]
            self._see(at, "", 0)
        self._merge_states()
        self._freeze()

    def _state(self) -> int:
        for x, v in ((self.n, 0), (self.next, {}), (self.seen, Counter()), (self.left, Counter())):
            x.append(v)
        return len(self.n) - 1

    def _see(self, at: int, c: str, left: int) -> None:
        self.n[at] += 1
        self.seen[at][c] += 1
        self.left[at][left] += 1

    def _apart(self, x: int, y: int) -> float:
        """The greatest difference between two states, 1 or more if they are not compatible."""
        nx, ny = self.n[x], self.n[y]
        if not nx or not ny:
            return 0.0
        most = max(abs(self.seen[x][c] / nx - self.seen[y][c] / ny) for c in self.seen[x].keys() | self.seen[y].keys())
        for move in self.next[x].keys() | self.next[y].keys():
            both = (sum(n for c, n in self.seen[s].items() if c and symbol(c) == move) / self.n[s] for s in (x, y))
            most = max(most, abs(next(both) - next(both)))
        sum_x = sum_y = 0
        for length in sorted(self.left[x].keys() | self.left[y].keys()):
            sum_x += self.left[x][length]
            sum_y += self.left[y][length]
            most = max(most, abs(sum_x / nx - sum_y / ny))
        return most / (self.bound * (1 / sqrt(nx) + 1 / sqrt(ny)))

    def _differ(self, x: int, y: int) -> float | None:
        """How far two states are apart, None if they or states that they lead to aren't compatible."""
        own = self._apart(x, y)
        todo, done = [(x, y)], set()
        while todo:
            pair = todo.pop()
            if pair in done:
                continue
            done.add(pair)
            x, y = pair
            if self._apart(x, y) >= 1:
                return None
            todo += [(self.next[x][m], self.next[y][m]) for m in self.next[x].keys() & self.next[y].keys()]
        return own

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.n[x] += self.n[y]
            self.seen[x].update(self.seen[y])
            self.left[x].update(self.left[y])
            for move, child in self.next[y].items():
                if move in self.next[x]:
                    todo.append((self.next[x][move], child))
                else:
                    self.next[x][move] = child

    def _merge_states(self) -> None:
        red = [0]
        kept = {0}
        while True:
            # The most seen state that is not yet decided on; ties by age.
            blue = max(((self.n[t], -t, s, m) for s in red for m, t in self.next[s].items() if t not in kept), default=None)
            if blue is None:
                self.states = red
                return
            t, source, move = -blue[1], blue[2], blue[3]
            fits = [(d, r) for r in red if (d := self._differ(r, t)) is not None]
            if fits:
                r = min(fits)[1]
                self.next[source][move] = r
                self._fold(r, t)
            else:
                red.append(t)
                kept.add(t)

    def _freeze(self) -> None:
        """Log-probabilities with half a count added for each class, for the end and for each character
        of a class; a move that was never seen leads to the start."""
        number = {s: i for i, s in enumerate(self.states)}
        self.step = []
        self.stop = []
        for s in self.states:
            total = log(self.n[s] + 0.5 * (len(SYMBOLS) + 1))
            by = {m: sum(self.seen[s][c] for c in ALPHABET if symbol(c) == m) for m in SYMBOLS}
            self.step.append({c: (log(by[m] + 0.5) - total + log((self.seen[s][c] + 0.5) / (by[m] + 0.5 * _SIZE[m])), number[self.next[s][m]] if m in self.next[s] else 0) for c in ALPHABET for m in (symbol(c),)})
            self.stop.append(log(self.seen[s][""] + 0.5) - total)

    def score(self, string: str) -> float:
        """log P(string), its end included."""
        at, total, step = 0, 0.0, self.step
        for c in string:
            p, at = step[at][c]
            total += p
        return total + self.stop[at]

    def __getstate__(self):
        return {"step": self.step, "stop": self.stop}


class Formats:
    """Automata of kinds of credentials, and of plain runs of characters."""

    def __init__(self, labelled: dict[str, list[str]], plain: list[str], margin: float = MARGIN):
        usable = {k: sorted(x for x in v if len(x) <= LONGEST) for k, v in sorted(labelled.items())}
        self.kinds = {k: Automaton(v) for k, v in usable.items() if v}
        plain = sorted(x for x in plain if len(x) <= LONGEST)
        self.plain = Automaton(plain)
        # Credentials without a label are among the plain runs: those that a kind explains better are
        # taken out, and the automaton is fitted again, until there are none.
        for _ in range(ROUNDS if self.kinds else 0):
            left = [x for x in plain if max(a.score(x) for a in self.kinds.values()) - self.plain.score(x) < 1]
            if len(left) == len(plain):
                break
            plain = left
            self.plain = Automaton(plain)
        self.margin = margin
        self.known: dict[str, float] = {}

    def score(self, string: str) -> float:
        """Nats by which the likeliest kind is likelier than plain text."""
        known = self.known.get(string)
        if known is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            known = self.known[string] = max((a.score(string) for a in self.kinds.values()), default=float("-inf")) - self.plain.score(string)
        return known

    def spans(self, text: str) -> list[Span]:
        """Base spans and those of all candidates in a credential's format, by start, then kind."""
        more = [(a, len(BASE), b, a) for a, b in candidates(text) if self.score(text[a:b]) >= self.margin] if self.kinds else []
        return sorted(base_spans(text) + more)


def _texts(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")


def learn_formats(docs: DataFrame, text_col: str = "text", labelled: int = LABELLED, known: dict[str, list[str]] | None = None) -> Formats:
    """Automata for what the fixed patterns label in ``docs``, and for the credentials in ``known``, by kind.

    The labels of a kind are the distinct secrets that its pattern finds, and those of plain text
    the distinct candidates that no pattern touches. Of each, the ``labelled`` of least hash over
    all documents are fitted on: a uniform sample of a bounded size, the same for any partitioning.
    Without any label no candidate is in a format.
    """
    known = known or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {}
        held: dict[str, set] = {}

        def offer(kind: str, value: str) -> None:
            heap, own = heaps.setdefault(kind, []), held.setdefault(kind, set())
            if value not in own:
                entry = (-(xxhash.xxh3_64_intdigest(value.encode()) >> 1), value)
                if len(heap) < labelled:
                    heappush(heap, entry)
                    own.add(value)
                elif entry > heap[0]:
                    own.add(value)
                    own.discard(heappushpop(heap, entry)[1])

        for batch in batches:
            for t in batch.column(0):
                text = t.as_py()
                base = base_spans(text)
                for _, kind, end, start in base:
                    if end - start <= LONGEST:
                        offer(KINDS[kind], text[start:end])
                for a, b in candidates(text):
                    if b - a <= LONGEST and not any(s < b and a < e for s, _, e, _ in base):
                        offer("plain", text[a:b])
        rows = [(kind, -h, value) for kind, heap in heaps.items() for h, value in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["kind", "hash", "value"])

    found = docs.select(_texts(docs, text_col)).mapInArrow(lean(run), "kind string, hash long, value string").distinct().persist()
    try:
        got = {k: [r.value for r in found.where(F.col("kind") == k).orderBy("hash", "value").limit(labelled).collect()] for k in (*KINDS[:-1], "plain")}
    finally:
        found.unpersist()
    given = {x for strings in known.values() for x in strings}
    plain = [x for x in got.pop("plain") if x not in given]
    return Formats(got | {f"known {k}": list(v) for k, v in known.items()}, plain)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", formats: Formats | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end, secret>>): one row for each row of ``docs``, repeated ones too.

    Spans of the fixed patterns, leftmost and non-overlapping for each kind, and after the method
    those of kind ``format``, all by start, then kind. start:end is the whole match, ``secret``
    where the secret itself starts (after the key word of an assignment); code points, end
    exclusive. A ``format`` span may overlap a base one or be the same string: all candidates are
    scored. A null text counts as empty; an empty table gives an empty result. Without ``formats``,
    they are learned from ``docs``.
    """
    held = docs.sparkSession.sparkContext.broadcast(formats or learn_formats(docs, text_col))  # a few automata of LABELLED strings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = held.value.spans
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "secret": s} for a, k, b, s in spans(t.as_py())] for t in batch.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    own = docs.select(F.col(quoted(id_col)).alias("id"), _texts(docs, text_col))
    return own.mapInArrow(lean(run), f"id {own.dtypes[0][1]}, spans array<struct<kind:string,start:long,end:long,secret:long>>")


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each secret, or run of overlapping ones, replaced by ``mark``."""
    out, at, open_ = [], 0, -1
    for start, _, end, _ in sorted((s, 0, e, 0) for _, _, e, s in spans):
        if start >= open_:
            out += [text[at:start], mark]
        open_ = at = max(open_, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", formats: Formats | None = None) -> DataFrame:
    """``docs`` with its secrets replaced; the same rows and columns, whatever their names; repeated rows
    stay. A null text stays null; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(formats or learn_formats(docs, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = held.value.spans
        for batch in slices(batches):
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                found = spans(text) if text else []
                texts.append(redacted(text, found) if found else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_rows(docs, run, docs.schema)
