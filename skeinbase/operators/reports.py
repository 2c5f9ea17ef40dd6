"""Whole answers: retrieval with all its tracks, product tree, snapshot, state block, review before a commit."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import notes, paths, scores, text
from . import freshness, serving
from .graph import cut, written
from .retrieval import found_sets, keep_best, rarest_terms, top_rows

BEGIN, END = "<!-- state:begin -->", "<!-- state:end -->"


def all_tracks(queries: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: DataFrame, drift: DataFrame, k: int = 5, floor: int = 2, silent=("chore",), boost: str | None = None) -> DataFrame:
    """(qid, track, rank, node_id, file, relevance, hits, drift) for queries (qid, term).

    Tracks: ``result``, by relevance and facets, of nodes with ``floor`` hits; ``code``, by relevance, tests at
    half, importance for ties; ``knowledge``, by relevance and facets; then for the best code's file ``blast``
    and ``task``. Nodes with a silent facet are in none; a query below the floor has no results: its only
    row is of the track ``silenced``. Notes of one title and file are told once.

    Queries of the same terms are answered once. Nodes that no query can tell apart (the same terms in the same
    anchors, length and weights) keep their first ``k`` in each order before queries meet them, so that a word which
    a share of all nodes has gives a few rows a query; what is left out stands behind ``k`` others wherever it is found.
    """
    terms = rarest_terms(queries, anchors)
    sets = written(terms.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("asked")))
    same = sets.groupBy("asked").agg(F.min("qid").alias("one"))
    per_node = written(found_sets(terms, anchors))
    length = anchors.groupBy("node_id").agg(F.count("*").alias("length"))
    stats = length.agg(F.count("*").alias("documents"), F.avg("length").alias("average"))
    df = per_node.select(F.explode(F.array_distinct(F.flatten("found"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    own = nodes.where(~F.arrays_overlap("facets", F.array(*map(F.lit, silent)))) if silent else nodes
    weight = scores.facet_weight(F.col("facets"))
    boosted = weight * F.when(F.array_contains("facets", boost), 1.5).otherwise(1.0) if boost else weight
    once = F.when((F.col("kind") == "code-symbol") | F.col("title").isNull(), F.col("id").cast("string")).otherwise(F.concat_ws("\x01", "title", F.coalesce("file", F.lit(""))))
    own = own.select(F.col("id").alias("node_id"), "file", "importance", once.alias("once"), (F.col("kind") == "code-symbol").alias("code"), weight.alias("weight"), boosted.alias("boosted"), F.when(paths.is_test(F.col("file")), 0.5).otherwise(1.0).alias("tested"))
    like = ["found", "length", "code", "weight", "boosted", "tested"]
    alike = per_node.join(length, "node_id").join(own, "node_id")
    told = alike.groupBy(*like, "once").agg(F.min(F.struct("node_id", "file", "importance")).alias("m")).select(*like, "once", "m.*")
    kept = top_rows(told, like, ["node_id"], max(k, 3)).unionByName(top_rows(alike, like, [F.desc_nulls_last("importance"), "node_id"], k).where("code")).drop("rank").dropDuplicates(["node_id"])
    kept = written(kept)

    asked = same.select(F.col("one").alias("qid"), "asked", F.explode("asked").alias("term")).join(df, "term").join(F.broadcast(stats))  # one row of totals
    met = kept.withColumn("term", F.explode(F.array_distinct(F.flatten("found")))).join(asked, "term")
    tf = F.size(F.filter("found", lambda x: F.array_contains(x, F.col("term"))))
    part = scores.bm25(tf, F.col("df"), F.col("length"), F.col("documents"), F.col("average"))
    hits = F.size(F.filter("found", lambda x: F.arrays_overlap(x, F.col("asked")))).cast("long")
    rows = met.withColumns({"part": part, "hits": hits}).groupBy("qid", "node_id").agg(F.sum("part").alias("relevance"), F.first("hits").alias("hits")).join(kept, "node_id")
    rows = cut(rows.withColumns({"weighted": F.round(F.col("relevance") * F.col("weight"), 2), "scored": F.round(F.col("relevance") * F.col("boosted"), 2), "coded": F.round(F.col("relevance") * F.col("tested"), 6)}))
    shape = ["qid", "track", "rank", "node_id", "file", "relevance", "hits"]

    def track(name: str, df: DataFrame, value: str, order: list, top: int) -> DataFrame:
        best = keep_best(df, ["qid", "once"], order)
        return top_rows(best, ["qid"], order, top).select("qid", F.lit(name).alias("track"), "rank", "node_id", "file", F.round(value, 2).alias("relevance"), "hits")

    results = track("result", rows.where(F.col("hits") >= floor), "scored", [F.desc("scored"), F.desc("hits"), "node_id"], 3)
    code = track("code", rows.where("code"), "relevance", [F.desc("coded"), F.desc_nulls_last("importance"), "node_id"], k)
    knowledge = track("knowledge", rows.where("not code"), "weighted", [F.desc("weighted"), "node_id"], k)
    heard = cut(results.unionByName(code).unionByName(knowledge).join(results.select("qid").distinct(), "qid", "left_semi"))
    top = heard.where("track = 'code' and rank = 1").select("qid", paths.normal(F.col("file")).alias("file"))
    blast = top.join(serving.blast(nodes, edges), "file").select("qid", F.lit("blast").alias("track"), "rank", F.lit(None).cast("long").alias("node_id"), F.col("dependent").alias("file"), F.col("importance").alias("relevance"), F.lit(0).cast("long").alias("hits"))
    tasks = top.join(serving.open_tasks(nodes, edges), "file").select("qid", F.lit("task").alias("track"), "rank", "node_id", "file", F.lit(0.0).alias("relevance"), F.lit(0).cast("long").alias("hits"))
    as_asked = written(sets.join(same, "asked").select(F.col("qid").alias("each"), F.col("one").alias("qid")))
    silenced = queries.select("qid").distinct().join(as_asked.join(heard.select("qid"), "qid", "left_semi").select(F.col("each").alias("qid")), "qid", "left_anti").select("qid", F.lit("silenced").alias("track"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("string").alias("file"), F.lit(0.0).alias("relevance"), F.lit(0).cast("long").alias("hits"))
    every = heard.select(shape).unionByName(blast.select(shape)).unionByName(tasks.select(shape))
    every = every.join(as_asked, "qid").drop("qid").withColumnRenamed("each", "qid").select(shape).unionByName(silenced.select(shape))
    shown = freshness.shown_drift(nodes, drift, edges).withColumnRenamed("id", "node_id")
    return every.join(shown, "node_id", "left").select(*shape, "drift")


def product_tree(nodes: DataFrame) -> DataFrame:
    """(feature, commits, decisions, open, done): what belongs to each feature, the scope of commits' titles. A
    decision or task belongs to the first feature, by name, that its title names."""
    commits = nodes.where("kind = 'commit'").withColumn("feature", notes.feature(F.col("title"))).where("feature is not null").groupBy("feature").agg(F.count("*").alias("commits"))
    words = nodes.where(F.col("kind").isin("decision", "task")).select("id", "kind", notes.status(F.col("facets"), notes.ENDED_FIRST).alias("status"), F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9_-]+"))).alias("feature"))
    owned = words.join(commits.select("feature"), "feature").groupBy("id", "kind", "status").agg(F.min("feature").alias("feature"))
    counts = owned.groupBy("feature").agg(F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_if((F.col("kind") == "task") & (F.col("status") == "open")).alias("open"), F.count_if((F.col("kind") == "task") & (F.col("status") != "open")).alias("done"))
    return commits.join(counts, "feature", "left").na.fill(0)


def affected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, files): the files that each task affects, in order."""
    own = serving.with_files(nodes).select(F.col("id").alias("dst"), "file")
    tasks = nodes.where("kind = 'task'").select(F.col("id").alias("src"))
    rows = edges.where("kind = 'relates_to'").join(tasks, "src").join(own, "dst")
    return rows.groupBy(F.col("src").alias("task")).agg(F.sort_array(F.collect_set("file")).alias("files"))


def before_commit(nodes: DataFrame, edges: DataFrame, files: DataFrame, added: DataFrame) -> DataFrame:
    """(file, importance, dependents, open_tasks, reasons, check): what a change of ``files`` risks, and a check
    that its added lines (file, line) suggest, for files with a reason or a suggestion."""
    risk = serving.review(nodes, edges, files)
    lines = added.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("added"))
    checks = lines.select("file", notes.suggested_check(F.col("file"), F.col("added")).alias("check")).where("check is not null")
    return risk.join(checks, "file", "full")


def leaks(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file) of private notes that a change of ``files`` would publish."""
    return serving.with_files(nodes).where("private").join(files.select("file").distinct(), "file", "left_semi").select("id", "file")


def snapshot(nodes: DataFrame, edges: DataFrame, drift: DataFrame) -> DataFrame:
    """(section, json): one row each for files, authors, drift and product, as JSON lists in order."""
    def listed(name: str, rows: DataFrame, *order) -> DataFrame:
        own = F.struct(*order, *[c for c in rows.columns if c not in order])
        return rows.agg(F.to_json(F.array_sort(F.collect_list(own))).alias("json")).select(F.lit(name).alias("section"), "json")

    authors = nodes.where("kind = 'lesson' and author <> ''").groupBy("author").agg(F.count("*").alias("lessons"))
    levels = drift.groupBy("level").agg(F.count("*").alias("nodes"))
    files, _ = serving.file_graph(nodes, edges, drift)  # 400 rows at most
    return listed("files", files, "file").unionByName(listed("authors", authors, "author")).unionByName(listed("drift", levels, "level")).unionByName(listed("product", product_tree(nodes), "feature"))


def state_block(counts: dict, decisions: list[dict], broken: list[dict]) -> str:
    """The short state of a store, as text between marks."""
    lines = [BEGIN, f"{counts.get('files', 0)} files, {counts.get('lessons', 0)} lessons, {counts.get('open_tasks', 0)} open tasks, {counts.get('broken', 0)} broken claims"]
    lines += [f"- broken: {b['title']} ({b['file']})" for b in broken]
    lines += [f"- {d['title']}" for d in decisions]
    return "\n".join([*lines, END])


def write_block(path: str | Path, block: str) -> bool:
    """Puts the block into a text file in place of the one there, or at its end; whether anything changed."""
    path = Path(path)
    old = path.read_text(encoding="utf-8") if path.exists() else ""
    marked = re.compile(re.escape(BEGIN) + ".*?" + re.escape(END), re.S)
    new = marked.sub(lambda _: block, old, count=1) if marked.search(old) else (old.rstrip("\n") + "\n\n" if old.strip() else "") + block + "\n"
    if new != old:
        path.write_text(new, encoding="utf-8")
    return new != old


def migrated(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, at their defaults; its other columns stay. Doing it
    again changes nothing."""
    new = {f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(new) if new else df


def instructions(replies: DataFrame) -> DataFrame:
    """(id, at, title, body, anchors, tags, dropped): the notes that replies (id, reply) of a model ask for.

    A reply has a list of notes, or an object with one under ``notes`` or ``instructions``, in whatever text;
    ``headline`` and ``name`` stand for a title, ``why`` and ``text`` for a body, ``keywords`` for anchors. A
    note without a title or with fewer than two anchors is dropped, with the reason.
    """
    item = "struct<title:string,headline:string,name:string,body:string,why:string,text:string,anchors:array<string>,keywords:array<string>,tags:array<string>>"
    part = notes.json_part(F.col("reply"))
    listed = F.coalesce(*(F.from_json(part, f"{key} array<{item}>")[key] for key in ("notes", "instructions")))
    as_list = F.when(F.startswith(part, F.lit("[")), F.from_json(part, f"array<{item}>")).otherwise(listed)
    rows = replies.select("id", F.posexplode(as_list).alias("at", "n"))
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(f"n.{x}")), F.lit("")) for x in names))
    none = F.expr("cast(array() as array<string>)")
    anchors = text.clean_anchors(F.coalesce("n.anchors", "n.keywords", none))
    out = rows.select("id", "at", first("title", "headline", "name").alias("title"), first("body", "why", "text").alias("body"), anchors.alias("anchors"), text.canonical_tags(F.coalesce("n.tags", none)).alias("tags"))
    return out.withColumn("dropped", F.when(F.col("title").isNull(), "no title").when(F.size("anchors") < 2, "too few anchors"))


def open_store(spark: SparkSession, folder: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables of a store by name: those that are there, with columns added since, and empty ones for the rest."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return {name: migrated(spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}"), schema) if there(name) else spark.createDataFrame([], schema) for name, schema in schemas.items()}
