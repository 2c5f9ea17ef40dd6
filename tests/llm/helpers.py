"""Small tables that have it all: nulls, empty and long texts, ties, repeats, extra columns."""

import random

WORDS = "the of and river stone quiet morning window garden letter paper yellow engine bright hollow tower".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed=0, n=40):
    rng = random.Random(seed)
    out = [(i, sentence(rng, rng.randint(1, 120))) for i in range(n)]
    base = out[3][1]
    out += [(100, base), (101, base), (102, base + " tail"), (103, None), (104, ""), (105, " \t\n"), (106, "é日本 ünïcode ſtrange K"), (107, "x" * 5000), (108, "word " * 3000), (None, "a row without an id"), (100, base), (109, "a"), (110, "A\x00b\x01c")]
    return out


def frame(spark, rows, partitions=3):
    """With extra columns whose names the operators use for their own."""
    extra = [(i, t, "x", 1, 2, 3, "y", 4) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, id string, fp int, key int, n_words int, spans string, least int").repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
