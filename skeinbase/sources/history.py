"""Commit history, as tables: from logs that were written out, and their notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import notes, text
from ..functions.paths import normal

#: What ``git log -z --name-only --format=%H%x00%an%x00%ct%x00%s%x00%b%x00`` writes, one file for each repository.
SHA = r"^\s*[0-9a-f]{40}\s*$"


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(repo, log) of written logs, whole: a log is one repository's."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("repo"), F.col("content").cast("string").alias("log"))


def commits(logs: DataFrame) -> DataFrame:
    """(repo, at, sha, author, ts, subject, body, files): the commits of logs (repo, log), the newest first.

    The NUL-separated tokens are cut where a commit id stands alone; ids, author, time, subject and body come
    first, then the files. Tokens before the first id are left out.
    """
    tokens = logs.select("repo", F.posexplode(F.split("log", "\x00")).alias("i", "token"))
    starts = F.col("token").rlike(SHA).cast("int")
    own = tokens.withColumn("at", F.sum(starts).over(Window.partitionBy("repo").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).where("at >= 0")
    each = own.groupBy("repo", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("t"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rest = F.filter(F.transform(F.slice("t", 6, F.greatest(F.size("t") - 5, F.lit(0))), lambda x: normal(strip(x))), lambda x: x != "")
    return each.where(F.size("t") >= 5).select("repo", "at", strip(F.col("t")[0]).alias("sha"), strip(F.col("t")[1]).alias("author"), strip(F.col("t")[2]).cast("long").alias("ts"), strip(F.col("t")[3]).alias("subject"), strip(F.col("t")[4]).alias("body"), rest.alias("files"))


def newer_than(found: DataFrame, since: DataFrame) -> DataFrame:
    """Commits newer than the one of ``since`` (repo, sha) in their log; all of a repository without one, or
    whose commit its log doesn't have."""
    last = found.join(since.select("repo", "sha"), ["repo", "sha"]).groupBy("repo").agg(F.min("at").alias("last"))
    return found.join(last, "repo", "left").where(F.col("last").isNull() | (F.col("at") < F.col("last"))).drop("last")


def commit_files(found: DataFrame) -> DataFrame:
    """Distinct (repo, sha, file, ts, author)."""
    return found.select("repo", "sha", F.explode("files").alias("file"), "ts", "author").distinct()


def file_history(found: DataFrame) -> DataFrame:
    """(repo, file, created, created_by, changed, changed_by, commits)."""
    order = F.struct("ts", "sha")
    return commit_files(found).groupBy("repo", "file").agg(
        F.min("ts").alias("created"), F.min_by("author", order).alias("created_by"), F.max("ts").alias("changed"), F.max_by("author", order).alias("changed_by"), F.count("*").alias("commits")
    )


def recent(found: DataFrame, n: int = 60) -> DataFrame:
    """Each repository's newest commits: those that seed what changes together."""
    return found.where(F.col("at") < n)


def co_changed(found: DataFrame, n: int = 60) -> DataFrame:
    """(sha, file) of the source files of recent commits, for :func:`skeinbase.operators.graph.cochange`."""
    return recent(found, n).select("sha", F.explode(notes.sources_only(F.col("files"))).alias("file")).distinct()


def commit_nodes(found: DataFrame) -> DataFrame:
    """One node for each commit: a lesson where it has trailers, else a commit.

    (sha, kind, title, body, anchors, facets, file, predicate, outcome, edges, author). A commit without any
    anchor gives none.
    """
    message = F.concat("subject", F.lit("\n\n"), "body")
    own = found.withColumn("m", message)
    m = F.col("m")
    noted = notes.trailer(m, "anchors").isNotNull()
    base = F.filter(F.transform("files", lambda f: F.lower(F.regexp_replace(F.substring_index(f, "/", -1), r"\.[^.]*$", ""))), lambda b: F.length(b) >= 3)
    weak = F.array_union(text.anchors(F.concat_ws(" ", "subject", "body", F.array_join("files", " "))), base)
    given = F.filter(F.transform(F.split(notes.trailer(m, "anchors"), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    tags = F.transform(F.split(notes.trailer(m, "tags"), ","), F.trim)
    rows = own.select(
        "sha", F.when(noted, "lesson").otherwise("commit").alias("kind"), F.when(noted, notes.note_title(m)).when(F.col("subject") != "", F.col("subject")).otherwise(F.left("sha", F.lit(7))).alias("title"),
        F.when(noted, F.when(notes.explanation(m) != "", notes.explanation(m)).otherwise(notes.note_title(m))).when(F.col("body") != "", F.col("body")).alias("body"), F.when(noted, given).otherwise(weak).alias("anchors"),
        F.when(noted, F.coalesce(text.canonical_tags(tags), F.expr("cast(array() as array<string>)"))).otherwise(notes.commit_facets(F.col("subject"), F.col("files"))).alias("facets"), notes.main_file(F.col("files")).alias("file"),
        notes.trailer(m, "predicate").alias("predicate"), notes.trailer(m, "outcome").alias("outcome"), notes.trailer_edges(m).alias("edges"), "author",
    )
    return rows.where(F.size("anchors") > 0)


def dirty_files(status: DataFrame) -> DataFrame:
    """(file) of porcelain status lines (line); a rename's new path."""
    path = F.regexp_replace(F.trim(F.substring("line", 4, 1_000_000)), r'^"|"$', "")
    return status.select(F.when(path.contains(" -> "), F.regexp_replace(F.substring_index(path, " -> ", -1), r'^"|"$', "")).otherwise(path).alias("file")).where("file <> ''").distinct()


def snapshot(found: DataFrame, k: int = 100) -> DataFrame:
    """(repo, head, commits, latest): a repository's newest commit, how many there are, and the ``k`` newest as JSON."""
    newest = found.where(F.col("at") < k).groupBy("repo").agg(F.to_json(F.array_sort(F.collect_list(F.struct("at", F.left("sha", F.lit(7)).alias("sha"), "author", "subject")))).alias("latest"))
    return found.groupBy("repo").agg(F.min_by("sha", "at").alias("head"), F.count("*").alias("commits")).join(newest, "repo")


def blamed(steps: DataFrame, blame: DataFrame) -> DataFrame:
    """``steps`` (path, text, ...) with who wrote each and when: blame lines (path, line, author, ts) are matched by
    their first forty letters, marks and boxes aside; of several the newest."""
    key = lambda c: F.left(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*[-*]\s*\[[ x>-]\]\s*", ""), r"[^a-z0-9]+", ""), F.lit(40))
    of = blame.select("path", key(F.col("line")).alias("key"), "author", "ts").groupBy("path", "key").agg(F.max_by("author", "ts").alias("author"), F.max("ts").alias("ts"))
    return steps.withColumn("key", key(F.col("text"))).join(of, ["path", "key"], "left").drop("key")
