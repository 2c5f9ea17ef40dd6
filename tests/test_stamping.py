"""A batch against stamping one by one in plain Python."""

import random
import re

import pytest

from skeinbase.operators import stamping

NODES = "node_id long, title string, body string, anchors array<string>, facets array<string>, private boolean, predicate string, outcome string, file string"
NOTES = NODES.replace("node_id", "seq")


def words(title):
    return {w for w in re.findall("[a-z0-9_]+", title.lower()) if len(w) > 2}


def key(title):
    return re.sub(r"\s+", " ", title.strip().lower())


def alike(a, b):
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def one_by_one(nodes, notes):
    """The store and (seq, action, node, added) by the rule itself, note by note."""
    store = {n[0]: dict(title=n[1], body=n[2], anchors=list(n[3]), facets=list(n[4]), private=n[5], predicate=n[6], outcome=n[7]) for n in nodes}
    top, told = max(store, default=0) + 1, []
    for seq, title, body, anchors, facets, private, predicate, outcome, _ in sorted(notes):
        mine, into = set(anchors), None
        share = max((len(mine & set(n["anchors"])) / len(mine) for n in store.values()), default=0) if mine else 0
        if mine and share >= 0.45:
            near = [i for i in sorted(store) if mine & set(store[i]["anchors"])]
            into = next((i for i in near if key(store[i]["title"]) == key(title)), None)
            if into is None:
                best = max(((alike(key(title), key(store[i]["title"])), -i) for i in near), default=(0, 0))
                into = -best[1] if best[0] >= 0.6 else None
        if into is None:
            store[top + seq] = dict(title=title, body=body, anchors=list(anchors), facets=list(facets), private=private, predicate=predicate, outcome=outcome)
            told.append((seq, "NEW", top + seq, None))
            continue
        node = store[into]
        added = sorted(mine - set(node["anchors"]))
        node["anchors"] += added
        node["facets"] += [f for f in facets if f not in node["facets"]]
        node["private"] |= private
        node["predicate"], node["outcome"] = predicate or node["predicate"], outcome or node["outcome"]
        told.append((seq, "MERGE", into, added))
    return store, told


def batch(seed, n, n_nodes=60):
    rng = random.Random(seed)
    terms = [f"t{min(int(rng.expovariate(0.08)), 60)}" for _ in range(500)]
    title = lambda: rng.choice(["  The ", "the ", ""]) + " ".join(rng.choice(["cache", "index", "stale", "rows", "merge", "of", "gate", "queue"]) for _ in range(rng.randint(1, 4)))

    def row(i):
        return (i, title() or "x", rng.choice([None, "why"]), sorted({rng.choice(terms) for _ in range(rng.randint(0, 6))}), rng.sample(["docs", "bugfix", "plan"], rng.randint(0, 2)), rng.random() < 0.1, rng.choice([None, None, "contains:x", "absent:y"]), rng.choice([None, "done", "undone"]), None)

    return [row(10 * i + 3) for i in range(n_nodes)], [row(i) for i in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(0, 500), (1, 120)])
def test_a_batch_equals_one_by_one(spark, seed, n):
    nodes, notes = batch(seed, n)
    after, told = stamping.stamp_batch(spark.createDataFrame(nodes, NODES), spark.createDataFrame(notes, NOTES).repartition(5))
    store, want = one_by_one(nodes, notes)
    got = sorted((r.seq, r.action, r.node_id, r.added) for r in told.collect())
    assert got == want and {"NEW", "MERGE"} == {g[1] for g in got}
    rows = {r.node_id: r for r in after.collect()}
    assert rows.keys() == store.keys()
    for i, s in store.items():
        r = rows[i]
        assert (r.title.strip(), r.body, r.private, r.predicate, r.outcome, r.facets) == (s["title"].strip(), s["body"], s["private"], s["predicate"], s["outcome"], s["facets"])
        assert sorted(r.anchors) == sorted(s["anchors"])


def test_many_notes_of_one_title_and_anchor(spark):
    notes = [(i, "One title", None, ["a", f"b{i}"], [], False, None, None, None) for i in range(200)]
    where, rounds = stamping.decided(spark.createDataFrame([], "node_id long, title string, anchors array<string>"), spark.createDataFrame(notes, NOTES).select("seq", "title", "anchors"))
    assert where.select("node").distinct().count() == 1 and where.where("new").count() == 1 and rounds <= 3


def test_a_chain_in_which_each_note_needs_the_one_before(spark):
    notes = [(i, "Same title", None, [f"a{i}", f"a{i + 1}"], [], False, None, None, None) for i in range(6)]
    _, told = stamping.stamp_batch(spark.createDataFrame([], NODES), spark.createDataFrame(notes, NOTES))
    assert sorted((r.seq, r.action, r.node_id) for r in told.collect()) == [(0, "NEW", 1), *((i, "MERGE", 1) for i in range(1, 6))]


def test_checks_at_write_time(spark):
    long = "A first sentence that is long enough to be a title. " + "Then more and more of it " * 6
    rows = [
        (0, long, " ", [" A ", "a", ""], None, None, " ", "", "src/a.py"), (1, "t", None, None, None, None, "not a claim", None, None), (2, "t", None, None, None, None, "contains:" + "x" * 500, None, None), (3, "t", None, None, None, None, "contains:(a+)+", None, None),
        (4, "t", None, None, None, None, None, None, "../x.py"), (5, "t", None, None, None, None, None, None, "a/../../x.py"), (6, "t", None, None, None, None, None, None, "C:\\x.py"), (7, "t", None, None, None, None, None, None, "/etc/x"), (8, " ", None, None, None, None, None, None, None), (9, "t", None, None, None, None, "contains:x && absent:y", None, "a\\..\\x.py"),
    ]
    ready = {r.seq: r for r in stamping.prepared(spark.createDataFrame(rows, NOTES)).collect()}
    assert {i for i, r in ready.items() if r.rejected} == {1, 2, 3, 4, 5, 6, 7, 8}
    assert ready[0].title == "A first sentence that is long enough to be a title." and ready[0].body.startswith("Then more") and ready[0].anchors == ["a"] and ready[0].predicate is None and ready[0].outcome is None
    after, told = stamping.stamp_batch(spark.createDataFrame([], NODES), spark.createDataFrame(rows, NOTES))
    assert sorted((r.seq, r.action) for r in told.collect() if r.action != "REJECTED") == [(0, "NEW"), (9, "NEW")] and after.count() == 2


def test_no_notes_or_no_nodes(spark):
    nodes, notes = batch(3, 5, 4)
    after, told = stamping.stamp_batch(spark.createDataFrame(nodes, NODES), spark.createDataFrame([], NOTES))
    assert told.count() == 0 and after.count() == 4
    after, told = stamping.stamp_batch(spark.createDataFrame([], NODES), spark.createDataFrame([], NOTES))
    assert told.count() == 0 and after.count() == 0
