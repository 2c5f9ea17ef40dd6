"""The write path, on immutable tables: each step returns the new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .retrieval import keep_best


def stamp(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """``nodes`` with the rows of ``incoming`` (same columns) merged in by title.

    Columns: node_id, title, body, facets, private, predicate, outcome. An incoming row whose title is
    that of a node, case and white space aside, updates it: the newer body counts, predicate and
    outcome are never cleared, private stays private, facets are appended. Others are new. Incoming
    rows with one title are merged among themselves first, the latest id winning.
    """
    key = text.title_key(F.col("title")).alias("key")
    new = keep_best(incoming.select("*", key), ["key"], [F.desc("node_id")])
    old = nodes.select("*", key)
    both = old.alias("o").join(new.alias("n"), "key", "full")
    return both.select(
        F.coalesce("o.node_id", "n.node_id").alias("node_id"), F.coalesce("o.title", "n.title").alias("title"), F.coalesce("n.body", "o.body").alias("body"),
        F.array_union(F.coalesce("o.facets", F.expr("cast(array() as array<string>)")), F.coalesce("n.facets", F.expr("cast(array() as array<string>)"))).alias("facets"),
        (F.coalesce("o.private", F.lit(False)) | F.coalesce("n.private", F.lit(False))).alias("private"), F.coalesce("n.predicate", "o.predicate").alias("predicate"), F.coalesce("n.outcome", "o.outcome").alias("outcome"),
    )


def dedup_gate(index: DataFrame, incoming: DataFrame, least: float = 0.45) -> DataFrame:
    """(new_id, node_id, share): for each incoming (new_id, term) the node that has most of its terms, if
    ``least`` of them."""
    size = incoming.groupBy("new_id").agg(F.count("*").alias("n"))
    shared = incoming.join(index, "term").groupBy("new_id", "node_id").agg(F.count("*").alias("shared")).join(size, "new_id").withColumn("share", F.col("shared") / F.col("n"))
    return keep_best(shared.where(F.col("share") >= least), ["new_id"], [F.desc("shared"), "node_id"]).select("new_id", "node_id", "share")


def undo(nodes: DataFrame, edges: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a run, nor edges to nodes that went; doing it again changes nothing."""
    kept = nodes.where(~F.col("run").eqNullSafe(F.lit(run)))
    gone = nodes.where(F.col("run") == run).select("node_id")
    left = edges.where(~F.col("run").eqNullSafe(F.lit(run)))
    for end in ("src", "dst"):
        left = left.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return kept, left


def purge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without private nodes, and edges at them."""
    public = nodes.where("not coalesce(private, false)")
    hidden = nodes.where("private").select("node_id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(hidden.select(F.col("node_id").alias(end)), end, "left_anti")
    return public, left


def export(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Writes the public part, once counts have shown that nothing private is left."""
    public, left = purge(nodes, edges)
    hidden = nodes.where("private").select(F.col("node_id").alias("at"))
    leaks = public.where("private").count() + left.select(F.explode(F.array("src", "dst")).alias("at")).join(hidden, "at", "left_semi").count()
    if leaks:
        raise RuntimeError(f"{leaks} private rows would be exported")
    public.write.mode("overwrite").parquet(f"{folder}/nodes")
    left.write.mode("overwrite").parquet(f"{folder}/edges")
