import math

import numpy as np

from skeinbase.llm import codes

PARTS, ENTRIES, ROUNDS = 8, 16, 6


def frame(spark, rows):
    """With extra columns whose names the operator uses for its own."""
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, part int, code string, hash int")


def brute(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max(len(v) for _, v, _ in kept) // PARTS) * PARTS
    xs = [[math.floor(4096 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    step = width // PARTS
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, xs[j]))[:ENTRIES]
    out, books, errors = [""] * len(kept), [], [0] * len(kept)
    for p in range(PARTS):
        values = [tuple(x[p * step : (p + 1) * step]) for x in xs]
        book = [values[j] for j in first]

        def near(v, book=None):
            return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(ROUNDS):
            at = [near(v, book)[1] for v in values]
            for k in range(len(book)):
                mine = [v for v, a in zip(values, at, strict=True) if a == k]
                if mine:
                    book[k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        for j, v in enumerate(values):
            e, k = near(v, book)
            out[j] += f"{k:02x}"
            errors[j] += e
        books += [c for e in book for c in e]
    of = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        of[lab] = of.get(lab, 0) + e
    return sorted(((i, lab, c, e, of[lab]) for (i, _, lab), c, e in zip(kept, out, errors, strict=True)), key=repr), books


def check(spark, rows):
    found, books = codes.compress(frame(spark, rows))
    want, numbers = brute(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert books.ravel().tolist() == numbers


def vectors(n, d=16, seed=0):
    return np.random.default_rng(seed).normal(0, 0.2, (n, d)).round(2).tolist()


def test_equals_brute_force(spark):
    v = vectors(150)
    rows = [(500 - i, x, i % 3 if i % 7 else None) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 16, 1), (1002, [0.1] * 15 + [None], 2), (1003, [float("inf")] + [0.0] * 15, 2), (2000, [-0.00001] * 16, None)]
    check(spark, rows)


def test_repeated_rows_and_ids_and_null_ids(spark):
    v = vectors(40)
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(3, v[3], 0)] * 5 + [(3, v[4], 0), (3, v[3], 1), (None, v[5], None), (None, v[5], None), (None, v[6], None)]
    check(spark, rows)


def test_one_very_common_vector_and_part(spark):
    v = vectors(60)
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(100 + i, v[0], 1) for i in range(500)] + [(700 + i, v[1][:8] + x[8:], 2) for i, x in enumerate(vectors(60, seed=5))]
    check(spark, rows)


def test_more_copies_than_are_given_out_at_a_time(spark):
    old, codes.COPIES = codes.COPIES, 7
    try:
        v = vectors(20)
        check(spark, [(i, x, 1) for i, x in enumerate(v)] + [(2, v[2], 1)] * 20 + [(4, v[4], 1)] * 6 + [(5, v[5], 1)] * 13)
    finally:
        codes.COPIES = old


def test_few_rows_and_equal_entries(spark):
    check(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (0, [0.25] * 8, None)])


def test_lengths_that_are_no_multiple_of_the_parts(spark):
    check(spark, [(i, x[: 9 + i % 3], 0) for i, x in enumerate(vectors(40, 11))] + [(99, [], 0)])


def test_nothing(spark):
    for rows in ([], [(1, None, 2)]):
        found, books = codes.compress(frame(spark, rows))
        assert found.count() == 0 and books.size == 0


def test_far_entries_count_as_the_limit(spark):
    most = codes.limit(8) / 4096
    rows = [(i, x, 0) for i, x in enumerate(vectors(20, 8))]
    far, _ = codes.compress(frame(spark, rows + [(50, [1e300] * 8, 0), (51, [-1e300] * 8, 0)]))
    near, _ = codes.compress(frame(spark, rows + [(50, [most] * 8, 0), (51, [-most] * 8, 0)]))
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))
    assert all(r["error"] >= 0 for r in far.collect())
