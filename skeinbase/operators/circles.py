"""What goes round in a directed graph (src, dst): strong components, and the elementary cycles in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Steps that the search for cycles may take in a component, and how many more for each of its edges.
BUDGET = 50_000
BUDGET_PER_EDGE = 16


def _mark(turn: int) -> Column:
    """A node with a number that is random in each turn: the order that labels are compared in."""
    return F.struct(F.xxhash64(F.lit(turn), "node").alias("number"), F.col("node"))


def spread_labels(pairs: DataFrame, turn: int = 0, max_rounds: int = 10_000) -> tuple[DataFrame, int]:
    """((node, above, below), rounds): of each node on a pair the least label of those that reach it and of those
    that it reaches, itself included, labels being (number, node) in the order of ``turn``.

    A round takes labels one step along the pairs, and then to the label's own node and what is known
    there: whatever reaches a label's node reaches the node too. With labels in a random order the distance
    covered grows by a factor in each round, so that a ring of n nodes takes O(log n) of them.
    """
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = written(nodes.select("node", _mark(turn).alias("above"), _mark(turn).alias("below")))
    last = None
    for done in range(1, max_rounds + 1):
        down = pairs.join(known, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "above", F.lit(None).alias("below"))
        up = pairs.join(known, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), F.lit(None).alias("above"), "below")
        near = written(known.unionByName(down).unionByName(up).groupBy("node").agg(F.min("above").alias("above"), F.min("below").alias("below")))
        known = written(_follow(_follow(near, near), near))
        now = known.agg(F.bit_xor(F.xxhash64("node", "above", "below"))).first()[0]
        if now == last:
            return known, done
        last = now
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def _follow(near: DataFrame, known: DataFrame) -> DataFrame:
    """Each label, or what is known at its own node if that is less."""
    a = known.select(F.col("node").alias("at_a"), F.col("above").alias("more_a"))
    b = known.select(F.col("node").alias("at_b"), F.col("below").alias("more_b"))
    met = near.join(a, F.col("above.node") == F.col("at_a")).join(b, F.col("below.node") == F.col("at_b"))
    return met.select("node", F.least("above", "more_a").alias("above"), F.least("below", "more_b").alias("below"))


def strong_components(pairs: DataFrame, max_turns: int = 200) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their least node.

    In each turn labels are spread both ways (:func:`spread_labels`). Nodes that one node both reaches and
    is reached by are its component: all nodes are pivots at once. Nodes of one component have the same two
    labels, so that only pairs within the same two labels are left for the next turn, which has a new
    order. Self loops, repeated pairs and pairs with a null end count for nothing.
    """
    left, out = written(pairs.where("src <> dst").select("src", "dst").distinct()), None  # three joins read them
    for turn in range(max_turns):
        ends = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = written(left.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi"))  # nodes without a way in or out are alone
        if left.isEmpty():
            break
        ways, _ = spread_labels(left, turn)
        found = ways.where("above.node = below.node").select("node", F.col("above.node").alias("pivot"))
        out = found if out is None else out.unionByName(found)
        rest = ways.where("above.node <> below.node")
        at = {end: rest.select(F.col("node").alias(end), F.struct("above.node", "below.node").alias(f"of_{end}")) for end in ("src", "dst")}
        left = left.join(at["src"], "src").join(at["dst"], "dst").where("of_src = of_dst").select("src", "dst")
    else:
        raise RuntimeError(f"components are left after {max_turns} turns")
    if out is None:
        return pairs.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    names = out.groupBy("pivot").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return out.join(names, "pivot").select("node", "component")


def elementary_cycles(pairs: DataFrame, longest: int | None = None, budget: int | None = BUDGET, per_edge: int = BUDGET_PER_EDGE) -> tuple[DataFrame, DataFrame]:
    """(cycles, components): each elementary cycle once, as (component, files, length) from its least node on; and
    (component, n_files, n_edges, n_cycles, complete_to, truncated).

    A cycle lies in one strong component. Within each, paths grow by one step at a time from every node, over
    greater nodes only, all components at once; a path closes where a pair leads back to its start. A
    component may take ``budget`` steps, or ``per_edge`` for each of its pairs if that is more (None: as many as it
    takes): before a round its steps are counted, and one that would go beyond stops there. Its cycles of up to
    ``complete_to`` nodes are then whole and ``truncated`` says that longer ones may be missing, as it does where
    ``longest`` ended the search. Self loops count for nothing; no pairs give no rows.
    """
    own = written(pairs.where("src <> dst").select("src", "dst").distinct())  # read twice, and made but once
    parts = written(strong_components(own))
    at = {end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst")}
    inside = own.join(at["src"], "src").join(at["dst"], "dst").where("c_src = c_dst").select(F.col("c_src").alias("component"), "src", "dst")
    ways = inside.groupBy("src").agg(F.count("*").alias("ways"))
    inside = written(inside.join(ways.withColumnRenamed("src", "dst"), "dst").select("component", "src", "dst", "ways"))
    step = inside.select(F.col("src").alias("end"), F.col("dst").alias("next"), F.col("ways").alias("next_ways"))
    back = inside.select(F.col("src").alias("end"), F.col("dst").alias("start"))
    most = F.lit(2**62) if budget is None else F.greatest(F.lit(budget), F.col("n_edges") * per_edge)
    purse = written(inside.groupBy("component").agg(F.countDistinct("src").alias("n_files"), F.count("*").alias("n_edges")).select("*", most.alias("left"), F.lit(0).alias("stopped")))
    paths = inside.where("src < dst").select("component", F.array("src", "dst").alias("files"), F.col("src").alias("start"), F.col("dst").alias("end"), "ways")
    found, length = inside.select("component", F.array("src").alias("files"), F.lit(0).alias("length")).limit(0), 2
    while True:
        closed = written(paths.join(back, ["start", "end"], "left_semi").select("component", "files", F.lit(length).alias("length")))
        found = found.unionByName(closed)
        cost = paths.groupBy("component").agg(F.sum("ways").alias("cost"))
        ends = F.lit(longest is not None and length >= longest)
        spent = purse.join(cost, "component", "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
        stop = F.when((F.col("stopped") == 0) & (F.col("cost") > 0) & (ends | (F.col("cost") > F.col("left"))), length).otherwise(F.col("stopped"))
        purse = written(spent.select("component", "n_files", "n_edges", (F.col("left") - F.when(stop == 0, F.col("cost")).otherwise(0)).alias("left"), stop.alias("stopped")))
        going = paths.join(purse.where("stopped = 0").select("component"), "component", "left_semi")
        more = going.join(step, "end").where((F.col("next") > F.col("start")) & ~F.array_contains("files", F.col("next")))
        paths = written(more.select("component", F.concat("files", F.array("next")).alias("files"), "start", F.col("next").alias("end"), F.col("next_ways").alias("ways")))
        length += 1
        if paths.isEmpty():
            break
    counted = found.groupBy("component").agg(F.count("*").alias("n_cycles"))
    whole = F.when(F.col("stopped") > 0, F.least("stopped", "n_files")).otherwise(F.col("n_files"))
    told = purse.join(counted, "component", "left").select("component", "n_files", "n_edges", F.coalesce("n_cycles", F.lit(0)).alias("n_cycles"), whole.alias("complete_to"), ((F.col("stopped") > 0) & (F.col("stopped") < F.col("n_files"))).alias("truncated"))
    return found, told


def by_importance(cycles: DataFrame, importance: DataFrame) -> DataFrame:
    """(files, length, importance, rank): cycles in the order of the most important file on them (``importance``:
    file, importance; 0 where it has none), then the shortest, then by files."""
    on = cycles.select("files", "length", F.explode("files").alias("file")).join(importance, "file", "left")
    top = on.groupBy("files", "length").agg(F.round(F.coalesce(F.max("importance"), F.lit(0.0)), 1).alias("importance"))
    return top.orderBy(F.desc("importance"), "length", "files")
