"""Names in texts against all pairs."""

import random

from skeinbase.operators import substrings


def frames(spark, texts, names):
    return spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name string, order long")


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    bits = ["au", "th", "log", "in", " ", "-", ".*", "Ü", "x", "ca", "che", "日本", "(", "%", "_"]
    make = lambda most: "".join(rng.choice(bits) for _ in range(rng.randint(0, most)))
    texts = [(i, make(14)) for i in range(300)] + [(900, None), (901, ""), (902, "the Login Cache of it"), (902, "again: LOGIN")]
    names = [(make(3), rng.randrange(50)) for _ in range(120)] + [("login cache", 1), ("login", 2), ("i", 60), ("nowhere at all", 0), ("", 0), (None, 0), ("Ü", 70), ("login", 5)]
    t, n = frames(spark, texts, names)
    want = {(i, name) for i, text in texts if text is not None for name, _ in names if name and name.lower() in text.lower()}
    assert set(map(tuple, substrings.contained(t, n).collect())) == want
    first = {}
    for i, name in want:
        key = (min(o for x, o in names if x == name), name)
        first[i] = min(first.get(i, key), key)
    assert dict(map(tuple, substrings.first_contained(t, n).collect())) == {i: name for i, (_, name) in first.items()}


def test_nothing(spark):
    for texts, names in (([], [("a", 1)]), ([(1, "abc")], []), ([(1, "abc")], [("abcd", 1), ("ad", 1)])):
        assert substrings.first_contained(*frames(spark, texts, names)).count() == 0
