import random

import numpy as np
import pytest

from skeinbase.llm import substrings

from .helpers import empty, frame, sentence, texts


def brute(rows):
    """By order of (id, a null one last); equal rows are one document."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data, own = (t or "").encode(), set()
        cover = np.zeros(len(data) + 1, np.int64)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(data[p : p + 100])
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[i, t] = (len(data), int(gone.sum()), runs, kept)
    return sorted((str(i), *out[i, t]) for i, t in rows)


def repeated_rows():
    rng = random.Random(11)
    rows = texts(5)
    line = sentence(rng, 40)
    rows += [(200 + i, f"{sentence(rng, 15)} {line}\n{sentence(rng, 15)}") for i in range(12)]
    rows += [(300, "a" * 350), (301, "ab" * 300), (302, "a" * 99), (303, "a" * 100), (304, "aab" * 100 + "b" * 150), (305, "éß日" * 120), (306, "\x00" * 250)]
    return rows


def run(spark, rows):
    found = substrings.remove_repeats(frame(spark, rows)).collect()
    return sorted((str(r.id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found)


@pytest.mark.parametrize("hot, at_once", [(50_000, 2_000_000), (3, 2_000_000), (50_000, 700)])
def test_matches_brute_force(spark, monkeypatch, hot, at_once):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "AT_ONCE", at_once)
    monkeypatch.setattr(substrings, "STRETCHES", 50)
    rows = repeated_rows()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("full, hot", [(0, 50_000), (16, 50_000), (16, 3)])
def test_a_map_that_is_full_loses_nothing(spark, monkeypatch, full, hot):
    """Neither with the map as it is, nor with a join in its place."""
    monkeypatch.setattr(substrings, "MAP_BITS", 6)
    monkeypatch.setattr(substrings, "FULL", full)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = repeated_rows()
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert substrings.remove_repeats(empty(spark)).collect() == []


def test_packed_stretches_come_back_and_equal_ones_as_ranges():
    rng = random.Random(2)
    data = [sentence(rng, 60).encode() for _ in range(5)] + [b"A" * 130]
    doc, start, place, size, h = substrings.stretches(data)
    texts = [data[d][s : s + n] for d, s, n in zip(doc, start, size)]
    blocks = [substrings.unpack(b) for _, b in substrings.pack([(doc, doc * 10, start, place, h, texts)], 3)]
    got = {(int(i), int(t), int(s), int(x), b) for i, t, s, x, _, b, _ in blocks for i, t, s, x, b in zip(i, t, s, x, b)}
    assert got == {(int(a), int(a) * 10, int(b), int(c), d) for a, b, c, d in zip(doc, start, h, texts) if a < 5 or b == 0}
    assert [x.tolist() for *_, gone in blocks for x in gone.T] == [[5, 50, 1, 130]]
