"""The engine's tables, as views of the tables at hand.

A document is a node, a benchmark text a query, a label feedback; a part is a file, an order a commit,
its lines the files it touched; edges between parts that follow one another in an order are typed by
the line's return flag; an event is a row of the access log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all cores, by the columns given if any, if it comes from fewer files than there are: one file of one row
    group is else one task's work, however long its texts. Tables of many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if len(df._jdf.inputFiles()) < cores else df


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, kind, title, body, facets, file)."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").join(marks, "doc_id", "left")
    facets = F.array_compact(F.array(F.when(F.col("quality") == 1, "security"), F.when(F.col("quality") == 0, "docs"), F.when(F.col("toxic") == 1, "chore")))
    return docs.select(F.col("doc_id").alias("node_id"), F.when(F.col("lang") == "de", "decision").otherwise("lesson").alias("kind"), text.first_line(F.col("text")).alias("title"), F.col("text").alias("body"), facets.alias("facets"), F.col("source").alias("file"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (sha, file, ts)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))
    return lines.join(orders, "sha").select("sha", "file", "ts")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind) between parts."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "N", "depends_on").when(F.col("l_returnflag") == "A", "implements").otherwise("guarded_by")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), kind.alias("kind"))
    return lines.where("dst is not null and src <> dst").distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, name, area, importance)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"), F.col("p_size").cast("double").alias("importance"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are asked about: those whose number is divisible by 50."""
    return files(spark, sf_dir).where("file % 50 = 0").select(F.col("file").alias("target"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, kind, node_id, score, consumer, surfaced)."""
    consumer = F.get_json_object("props", "$.k").cast("long") % 4
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"), F.col("user_id").alias("node_id"), F.col("value").alias("score"), consumer.alias("consumer"), (F.col("event_type") != "error").alias("surfaced"))


# The same views in SQL.
SQL = {
    "nodes": """nodes AS (SELECT doc_id AS node_id, CASE WHEN lang = 'de' THEN 'decision' ELSE 'lesson' END AS kind, split_part(text, chr(10), 1) AS title, text AS body,
  list_filter([CASE WHEN quality = 1 THEN 'security' END, CASE WHEN quality = 0 THEN 'docs' END, CASE WHEN toxic = 1 THEN 'chore' END], lambda x: x IS NOT NULL) AS facets, source AS file
  FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))""",
    "commit_files": """commit_files AS (SELECT sha, file, o_orderdate AS ts FROM (SELECT DISTINCT l_orderkey AS sha, l_partkey AS file FROM lineitem) JOIN orders ON o_orderkey = sha)""",
    "edges": """edges AS (SELECT DISTINCT src, dst, kind FROM (SELECT l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
  CASE l_returnflag WHEN 'N' THEN 'depends_on' WHEN 'A' THEN 'implements' ELSE 'guarded_by' END AS kind FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)""",
    "pairs": "pairs AS (SELECT DISTINCT src, dst FROM edges)",
    "files": "files AS (SELECT p_partkey AS file, p_name AS name, p_brand AS area, p_size::DOUBLE AS importance FROM part)",
    "targets": "targets AS (SELECT p_partkey AS target FROM part WHERE p_partkey % 50 = 0)",
    "cochange": """sized AS (SELECT sha FROM commit_files GROUP BY sha HAVING count(*) BETWEEN 2 AND 12),
kept AS (SELECT sha, file FROM commit_files WHERE sha IN (SELECT sha FROM sized)),
cochange AS (SELECT x.file AS a, y.file AS b, count(*) AS commits FROM kept x JOIN kept y ON x.sha = y.sha AND x.file <> y.file GROUP BY 1, 2)""",
    "access_log": "access_log AS (SELECT event_id AS id, ts, event_type AS kind, user_id AS node_id, value AS score, (json_extract_string(props, '$.k')::BIGINT) % 4 AS consumer, event_type <> 'error' AS surfaced FROM events)",
}


def with_views(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body.strip()
