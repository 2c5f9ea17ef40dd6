"""A whole store, as views of the tables at hand, and the same views in SQL.

Four parts are the symbols of one file; an order is a note, pinned to the file of its first part at the
commit that the order is; its lines are edges to the parts, typed by line number; a customer's later order
supersedes an earlier one now and then; parts that follow one another in an order depend on each other.
Every nineteenth file is gone, every twenty-third has open edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bindings as B

NOTE = 1_000_000_000
KINDS = ("lesson", "decision", "commit", "task", "plan")
RELATIONS = ("supersedes", "relates_to", "warns_about", "decided_by", "guarded_by")


def _file(g):
    name = F.concat(F.lit("m"), g.cast("string"))
    return F.when(g % 9 == 0, F.concat(F.lit("tests/test_"), name, F.lit(".py"))).when(g % 11 == 0, F.concat(F.lit("src/"), name, F.lit("/__init__.py"))).when(g % 13 == 0, F.concat(F.lit("src\\"), name, F.lit(".TS"))).when(g % 17 == 0, F.concat(F.lit("docs/"), name, F.lit(".md"))).otherwise(F.concat(F.lit("src/"), name, F.lit(".py")))


_FILE = "CASE WHEN {g} % 9 = 0 THEN 'tests/test_m' || {g} || '.py' WHEN {g} % 11 = 0 THEN 'src/m' || {g} || '/__init__.py' WHEN {g} % 13 = 0 THEN 'src\\m' || {g} || '.TS' WHEN {g} % 17 = 0 THEN 'docs/m' || {g} || '.md' ELSE 'src/m' || {g} || '.py' END"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, kind, title, body, facets, file, symbol, line, sha, origin, run, importance, predicate, outcome, private, created, author, text)."""
    part = B.table(spark, d, "part")
    none = lambda t: F.lit(None).cast(t)
    code = part.select(
        F.col("p_partkey").alias("id"), F.lit("code-symbol").alias("kind"), F.col("p_name").alias("title"), none("string").alias("body"), F.expr("cast(array() as array<string>)").alias("facets"), _file(F.floor(F.col("p_partkey") / 4)).alias("file"),
        F.translate("p_name", " ", "_").alias("symbol"), F.col("p_size").alias("line"), none("long").alias("sha"), F.lit("bootstrap").alias("origin"), none("int").alias("run"), (F.col("p_size") * 2.0).alias("importance"),
        none("string").alias("predicate"), none("string").alias("outcome"), F.lit(False).alias("private"), none("timestamp_ntz").alias("created"), none("string").alias("author"), none("string").alias("text"),
    )
    k = F.col("o_orderkey")
    first = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.floor(F.min("l_partkey") / 4).alias("g"))
    text = F.concat("o_orderstatus", F.lit(" says so\n"), "o_orderpriority")
    notes = B.table(spark, d, "orders").join(first, "o_orderkey", "left").select(
        (k + NOTE).alias("id"), F.array(*map(F.lit, KINDS))[(k % 5).cast("int")].alias("kind"), F.when(k % 6 == 0, F.concat(F.lit("ADR-"), (k % 89).cast("string"), F.lit(" choice"))).otherwise(F.concat("o_orderpriority", F.lit(" note "), (k % 211).cast("string"))).alias("title"), text.alias("body"),
        F.when(k % 4 == 0, F.array(F.lit("task"), F.lit("open"))).when(k % 4 == 1, F.array(F.lit("done"))).when(k % 4 == 2, F.array(F.lit("foundation"), F.lit("open"), F.lit("done"))).otherwise(F.array(F.lit("docs"))).alias("facets"), _file(F.col("g")).alias("file"),
        none("string").alias("symbol"), F.when(k % 2 == 0, (k % 50).cast("int")).alias("line"), k.alias("sha"), F.when(k % 3 == 0, "live").when(k % 3 == 1, "power").otherwise("bootstrap").alias("origin"), F.when(k % 3 == 1, (k % 2 + 1).cast("int")).alias("run"), (k % 100).cast("double").alias("importance"),
        F.when(k % 14 == 0, "contains: says so").when(k % 14 == 7, "absent: O says").alias("predicate"), F.when(k % 8 == 0, "kept").alias("outcome"), (F.col("o_orderpriority") == "1-URGENT").alias("private"), F.col("o_orderdate").alias("created"), F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("author"), text.alias("text"),
    )
    return code.unionByName(notes)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, verified, run, refined_from)."""
    lines = B.table(spark, d, "lineitem").select((F.col("l_orderkey") + NOTE).alias("src"), F.col("l_partkey").alias("dst"), F.array(*map(F.lit, RELATIONS))[(F.col("l_linenumber") % 5).cast("int")].alias("kind")).where("kind <> 'supersedes'")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    later = B.table(spark, d, "orders").select((F.lead("o_orderkey").over(w) + NOTE).alias("src"), (F.col("o_orderkey") + NOTE).alias("dst"), F.lit("supersedes").alias("kind")).where("src is not null and dst % 10 = 0")
    code = B.edges(spark, d).select("src", "dst", F.when(F.col("kind") == "guarded_by", "co_changed").otherwise(F.col("kind")).alias("kind"))
    every = lines.unionByName(later).unionByName(code).distinct()
    return every.select("src", "dst", "kind", ((F.col("src") + F.col("dst")) % 5 != 0).alias("verified"), F.when(F.col("src") % 7 == 0, 1).alias("run"), F.lit(None).cast("string").alias("refined_from"))


def known(spark: SparkSession, d: str) -> DataFrame:
    g = B.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("g")).distinct().where("g % 19 <> 0")
    return g.select(F.translate(_file(F.col("g")), "\\", "/").alias("file"))


def dirty(spark: SparkSession, d: str) -> DataFrame:
    g = B.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("g")).distinct().where("g % 23 = 0")
    return g.select(F.translate(_file(F.col("g")), "\\", "/").alias("file"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))


def touched(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (sha, file): the files that commits changed."""
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.translate(_file(F.floor(F.col("l_partkey") / 4)), "\\", "/").alias("file")).distinct()


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, term): a note's words, and now and then the path of the file of its last part."""
    k = F.col("o_orderkey")
    words = B.table(spark, d, "orders").select((k + NOTE).alias("node_id"), F.explode(F.split(F.lower("o_orderpriority"), "-")).alias("term"))
    last = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.floor(F.max("l_partkey") / 4).alias("g")).where("l_orderkey % 3 = 0")
    return words.unionByName(last.select((F.col("l_orderkey") + NOTE).alias("node_id"), F.lower(F.translate(_file(F.col("g")), "\\", "/")).alias("term"))).distinct()


def targets(spark: SparkSession, d: str) -> DataFrame:
    """The files asked about: those whose number is divisible by 50, and one that nothing knows."""
    g = B.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("g")).distinct().where("g % 50 = 0")
    return g.select(F.translate(_file(F.col("g")), "\\", "/").alias("file")).unionByName(spark.range(1).select(F.lit("nowhere/at_all.py").alias("file")))


_PATH = "replace(" + _FILE + ", '\\', '/')"
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_RELATIONS = "[" + ", ".join(f"'{k}'" for k in RELATIONS) + "]"

SQL = {
    "nodes": f"""nodes AS (SELECT p_partkey AS id, 'code-symbol' AS kind, p_name AS title, NULL::VARCHAR AS body, []::VARCHAR[] AS facets, {_FILE.format(g='(p_partkey // 4)')} AS file, replace(p_name, ' ', '_') AS symbol, p_size AS line, NULL::BIGINT AS sha, 'bootstrap' AS origin, NULL::INT AS run, p_size * 2.0::DOUBLE AS importance,
  NULL::VARCHAR AS predicate, NULL::VARCHAR AS outcome, false AS private, NULL::TIMESTAMP AS created, NULL::VARCHAR AS author, NULL::VARCHAR AS text FROM part
UNION ALL SELECT o_orderkey + {NOTE}, {_KINDS}[o_orderkey % 5 + 1], CASE WHEN o_orderkey % 6 = 0 THEN 'ADR-' || (o_orderkey % 89) || ' choice' ELSE o_orderpriority || ' note ' || (o_orderkey % 211) END, o_orderstatus || ' says so' || chr(10) || o_orderpriority,
  CASE o_orderkey % 4 WHEN 0 THEN ['task', 'open'] WHEN 1 THEN ['done'] WHEN 2 THEN ['foundation', 'open', 'done'] ELSE ['docs'] END, CASE WHEN g IS NOT NULL THEN {_FILE.format(g='g')} END, NULL, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'power' ELSE 'bootstrap' END, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 2 + 1 END, (o_orderkey % 100)::DOUBLE,
  CASE o_orderkey % 14 WHEN 0 THEN 'contains: says so' WHEN 7 THEN 'absent: O says' END, CASE WHEN o_orderkey % 8 = 0 THEN 'kept' END, o_orderpriority = '1-URGENT', o_orderdate, 'c' || (o_custkey % 20), o_orderstatus || ' says so' || chr(10) || o_orderpriority
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) // 4 AS g FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
filed AS (SELECT * REPLACE (replace(file, '\\', '/') AS file) FROM nodes WHERE file IS NOT NULL AND file <> '')""",
    "edges": f"""code_edges AS (SELECT DISTINCT src, dst, kind FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
  CASE l_returnflag WHEN 'N' THEN 'depends_on' WHEN 'A' THEN 'implements' ELSE 'co_changed' END AS kind FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
edges AS (SELECT src, dst, kind, (src + dst) % 5 <> 0 AS verified, CASE WHEN src % 7 = 0 THEN 1 END AS run FROM (
  SELECT l_orderkey + {NOTE} AS src, l_partkey AS dst, {_RELATIONS}[l_linenumber % 5 + 1] AS kind FROM lineitem WHERE l_linenumber % 5 <> 0
  UNION SELECT src, dst, 'supersedes' FROM (SELECT lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + {NOTE} AS src, o_orderkey + {NOTE} AS dst FROM orders) WHERE src IS NOT NULL AND dst % 10 = 0
  UNION SELECT src, dst, kind FROM code_edges))""",
    "tree": f"""known AS (SELECT {_PATH.format(g='g')} AS file FROM (SELECT DISTINCT p_partkey // 4 AS g FROM part) WHERE g % 19 <> 0),
dirty AS (SELECT {_PATH.format(g='g')} AS file FROM (SELECT DISTINCT p_partkey // 4 AS g FROM part) WHERE g % 23 = 0)""",
    "ranks": "ranks AS (SELECT o_orderkey AS sha, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS rank FROM orders)",
    "touched": f"touched AS (SELECT DISTINCT l_orderkey AS sha, {_PATH.format(g='(l_partkey // 4)')} AS file FROM lineitem)",
    "since": """since AS (SELECT file, sha, count(c.rank) AS commits_since FROM (SELECT DISTINCT file, sha, rank FROM filed JOIN ranks USING (sha)) s
  LEFT JOIN (SELECT file, rank FROM touched JOIN ranks USING (sha)) c USING (file) WHERE c.rank < s.rank GROUP BY 1, 2)""",
    "drift": r"""drift AS (SELECT id, file, CASE WHEN predicate IS NULL THEN moved WHEN verdict = 'BROKEN' THEN 'broken' WHEN line IS NOT NULL THEN 'fresh' ELSE moved END AS level FROM (
  SELECT id, file, line, predicate, CASE WHEN predicate LIKE 'contains%' AND contains(text, 'says so') OR predicate LIKE 'absent%' AND NOT contains(text, 'O says') THEN 'CONFIRMED' ELSE 'BROKEN' END AS verdict,
    CASE WHEN kind IN ('lesson', 'decision', 'task', 'plan') THEN CASE WHEN file NOT IN (SELECT file FROM known) THEN 'committed' WHEN file IN (SELECT file FROM dirty) THEN 'uncommitted' WHEN coalesce(commits_since, 0) > 0 THEN 'committed' ELSE 'fresh' END
      WHEN file IN (SELECT file FROM known) AND file IN (SELECT file FROM dirty) THEN 'uncommitted' ELSE 'fresh' END AS moved FROM filed LEFT JOIN since USING (file, sha)))""",
    "worst": "worst AS (SELECT file, arg_max(level, list_position(['fresh', 'committed', 'uncommitted', 'broken'], level)) AS drift FROM drift GROUP BY 1)",
    "anchors": f"""anchors AS (SELECT DISTINCT node_id, term FROM (SELECT o_orderkey + {NOTE} AS node_id, unnest(string_split(lower(o_orderpriority), '-')) AS term FROM orders
  UNION ALL SELECT l_orderkey + {NOTE}, lower({_PATH.format(g='g')}) FROM (SELECT l_orderkey, max(l_partkey) // 4 AS g FROM lineitem GROUP BY 1) WHERE l_orderkey % 3 = 0))""",
    "targets": f"targets AS (SELECT {_PATH.format(g='g')} AS file FROM (SELECT DISTINCT p_partkey // 4 AS g FROM part) WHERE g % 50 = 0 UNION ALL SELECT 'nowhere/at_all.py')",
    "ties": """ties AS (SELECT x.file AS a, y.file AS b, e.kind, src, dst, verified, CASE e.kind WHEN 'depends_on' THEN 5 WHEN 'implements' THEN 4 WHEN 'guarded_by' THEN 3 WHEN 'relates_to' THEN 2 WHEN 'co_changed' THEN 1 END AS tie, x.importance
  FROM edges e JOIN filed x ON x.id = src JOIN filed y ON y.id = dst WHERE x.file <> y.file)""",
    "importance": "weights AS (SELECT file, round(max(importance), 1) AS importance, count(*) AS symbols FROM filed WHERE kind = 'code-symbol' GROUP BY 1)",
    "blast": """per AS (SELECT b AS file, a AS dependent, kind, tie, max(importance) AS importance FROM ties WHERE tie IS NOT NULL GROUP BY ALL),
best AS (SELECT file, dependent, arg_max(kind, tie) AS kind, max(tie) AS tie, arg_max(importance, tie) AS importance FROM per GROUP BY 1, 2),
blast AS (SELECT file, dependent, kind, round(importance, 1) AS importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY tie DESC, importance DESC, dependent) AS rank FROM best) WHERE rank <= 20)""",
    "depends": "depends AS (SELECT file, target, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY tie DESC, target) AS rank FROM (SELECT DISTINCT a AS file, b AS target, kind, tie FROM ties WHERE tie IS NOT NULL)) WHERE rank <= 8)",
    "tasks": """open_tasks AS (SELECT file, node_id, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY node_id) AS rank FROM (SELECT DISTINCT f.file, t.id AS node_id, t.title FROM edges JOIN nodes t ON t.id = src JOIN filed f ON f.id = dst
  WHERE edges.kind = 'relates_to' AND t.kind = 'task' AND NOT list_has_any(t.facets, ['done', 'dropped', 'deferred']))) WHERE rank <= 4)""",
    "warns": """old AS (SELECT DISTINCT dst AS id FROM edges WHERE kind = 'supersedes'),
names AS (SELECT DISTINCT file, name FROM (SELECT file, lower(symbol) AS name FROM filed JOIN targets USING (file) UNION ALL SELECT file, lower(title) FROM filed JOIN targets USING (file) WHERE kind = 'code-symbol') WHERE name <> ''),
warned AS (SELECT DISTINCT src AS id, o.title, o.symbol, replace(o.file, '\\', '/') AS file FROM edges JOIN nodes o ON o.id = dst WHERE edges.kind = 'warns_about' AND src NOT IN (SELECT id FROM old)),
warns AS (SELECT file, node_id, kind, title, rank FROM (SELECT file, m.id AS node_id, kind, title, row_number() OVER (PARTITION BY file ORDER BY importance DESC NULLS LAST, m.id DESC) AS rank
  FROM (SELECT file, id FROM warned JOIN targets USING (file) UNION SELECT names.file, id FROM warned JOIN names ON name = lower(title) UNION SELECT names.file, id FROM warned JOIN names ON name = lower(symbol)) f JOIN (SELECT id, kind, title, importance FROM nodes) m ON m.id = f.id) WHERE rank <= 10)""",
    "why": """why AS (SELECT file, node_id, rank FROM (SELECT f.file, f.id AS node_id, row_number() OVER (PARTITION BY f.file ORDER BY f.id DESC) AS rank FROM (SELECT file, id FROM filed JOIN targets USING (file) UNION SELECT file, node_id FROM anchors JOIN targets ON term = lower(file)) f JOIN nodes n ON n.id = f.id WHERE n.kind NOT IN ('code-symbol', 'task', 'file')) WHERE rank <= 6)""",
}
NEEDS = {
    "since": ("nodes", "ranks", "touched"), "drift": ("since", "tree"), "worst": ("drift",), "ties": ("nodes", "edges"), "importance": ("nodes",), "blast": ("ties",), "depends": ("ties",),
    "tasks": ("nodes", "edges"), "warns": ("nodes", "edges", "targets"), "why": ("nodes", "anchors", "targets"),
}


def with_views(*names: str, body: str) -> str:
    """SQL with the views of these names and of all that they need before them."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + body.strip()
