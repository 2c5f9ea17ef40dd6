"""Freshness: what has moved since a claim was made, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims, notes
from ..functions.paths import normal
from .graph import cut


def commit_rank(commits: DataFrame) -> DataFrame:
    """``commits`` (sha, ts) with ``rank``: 0 for the newest, ties by sha.

    Rows are dealt by ranges of time, numbered within each and moved up by the sizes of the ranges
    before: no task sees all commits; only one count for each range comes to the driver.
    """
    order = [F.desc("ts"), F.desc("sha")]
    dealt = cut(commits.select("sha", "ts").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dict(dealt.groupBy("__part").count().collect())
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not before:
        return commits.select("sha", "ts", F.lit(0).cast("long").alias("rank"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("rank", (own + F.create_map(*before)[F.col("__part")]).cast("long")).drop("__part")


def commits_since(stamps: DataFrame, touches: DataFrame, ranks: DataFrame) -> DataFrame:
    """(file, sha, commits_since) for each distinct stamp (file, sha): how many commits of ``touches`` (sha,
    file) changed the file and are newer. A stamp whose commit is unknown has none: nothing is proven.

    Stamps and commits of a file go through one ordered pass, so that no stamp meets each commit.
    """
    of = ranks.select("sha", "rank")
    stamps = stamps.select("file", "sha").where("file is not null and sha is not null").distinct()
    rows = stamps.join(of, "sha").select("file", "rank", "sha", F.lit(0).alias("touch")).unionByName(touches.select("file", "sha").distinct().join(of, "sha").select("file", "rank", F.lit(None).cast(stamps.schema["sha"].dataType).alias("sha"), F.lit(1).alias("touch")))
    newer = F.sum("touch").over(Window.partitionBy("file").orderBy("rank", "touch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = rows.withColumn("commits_since", newer).where("touch = 0").select("file", "sha", "commits_since")
    return stamps.join(counted, ["file", "sha"], "left").select("file", "sha", F.coalesce("commits_since", F.lit(0)).cast("long").alias("commits_since"))


def moved_since(stamps: DataFrame, touches: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, sha, commits_since) for each distinct stamp (file, sha): 1 if any commit that touched the file is newer by
    ``commits`` (sha, ts), ties by sha, else 0: all that :func:`levels` asks. A file's newest commit says so; none are counted."""
    at = commits.select("sha", F.struct("ts", "sha").alias("at"))
    newest = touches.select("file", "sha").join(at, "sha").groupBy("file").agg(F.max("at").alias("last"))
    own = stamps.select("file", "sha").where("file is not null and sha is not null").distinct().join(at, "sha", "left").join(newest, "file", "left")
    return own.groupBy("file", "sha").agg(F.max(F.coalesce((F.col("last") > F.col("at")).cast("long"), F.lit(0).cast("long"))).alias("commits_since"))


def levels(nodes: DataFrame, since: DataFrame, known: DataFrame, dirty: DataFrame) -> DataFrame:
    """(id, file, level) of the nodes (id, kind, file, sha, line, predicate, text) that have a file.

    A claim's file is committed if it is gone or newer commits changed it, uncommitted if it has open
    edits, else fresh; other kinds show open edits only. A check that fails makes it broken; one that
    holds within the claim's own lines makes it fresh; one that holds somewhere in the file proves
    nothing. ``known`` and ``dirty`` are (file) of the work tree, ``since`` is of :func:`commits_since`.
    """
    own = nodes.where("file is not null and file <> ''").withColumn("file", normal(F.col("file")))
    rows = own.join(known.select("file", F.lit(True).alias("there")).distinct(), "file", "left").join(dirty.select("file", F.lit(True).alias("open")).distinct(), "file", "left").join(since, ["file", "sha"], "left")
    claim = F.col("kind").isin(*notes.CLAIMS)
    edited = F.col("there") & F.coalesce("open", F.lit(False))
    moved = F.when(F.col("there").isNull(), "committed").when(edited, "uncommitted").when(F.col("commits_since") > 0, "committed").otherwise("fresh")
    drift = F.when(claim, moved).when(edited, "uncommitted").otherwise("fresh")
    verdict = claims.verdict(F.col("predicate"), F.col("text"))
    checked = F.when(F.col("predicate").isNull(), drift).when(verdict == "BROKEN", "broken").when((verdict == "CONFIRMED") & F.col("line").isNotNull(), "fresh").otherwise(drift)
    return rows.select("id", "file", checked.alias("level"))


def worst_by_file(found: DataFrame) -> DataFrame:
    """(file, drift): the loudest level of a file's nodes."""
    return found.groupBy("file").agg(F.max_by("level", notes.level_rank(F.col("level"))).alias("drift"))


def verified(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``edges`` with ``verified`` set by the level of the node that they start from: true if fresh. Edges of
    nodes without a level keep theirs."""
    by = found.select(F.col("id").alias("src"), (F.col("level") == "fresh").alias("__now"))
    return edges.join(by, "src", "left").withColumn("verified", F.coalesce("__now", "verified")).select(*edges.columns)


def shown_drift(nodes: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, drift): a node's level; of one never looked at, committed if an edge at it is unverified."""
    ends = edges.where(~F.col("verified")).select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("bad", F.lit(True))
    rows = nodes.select("id").join(found.select("id", "level"), "id", "left").join(ends, "id", "left")
    return rows.select("id", F.coalesce("level", F.when(F.col("bad"), "committed")).alias("drift"))
