"""The queries over the whole store, each with SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import notes, paths, scores, text
from ..operators import freshness, graph, maintenance, reports, retrieval, serving, writing
from ..sources import links, versions
from . import bindings as B
from . import store as S
from .queries import _BM25, _POSTINGS, _TERMS, query

V = S.with_views


def _since(spark, d):
    stamps = serving.with_files(S.nodes(spark, d)).select("file", "sha")
    return freshness.commits_since(stamps, S.touched(spark, d), freshness.commit_rank(S.commits(spark, d)))


def _drift(spark, d, nodes=None):
    nodes = graph.written(S.nodes(spark, d)) if nodes is None else nodes
    since = freshness.moved_since(serving.with_files(nodes), S.touched(spark, d), S.commits(spark, d))
    return graph.cut(freshness.levels(nodes, since, S.known(spark, d), S.dirty(spark, d)))


def _file_graph(spark, d):
    nodes = graph.written(S.nodes(spark, d))
    return serving.file_graph(nodes, S.edges(spark, d), _drift(spark, d, nodes))


# Freshness.
@query(V("ranks", body="SELECT sha, rank FROM ranks"))
def commit_rank(spark, d):
    return freshness.commit_rank(S.commits(spark, d)).select("sha", "rank")


@query(V("since", body="SELECT DISTINCT file, sha, coalesce(commits_since, 0) AS commits_since FROM filed LEFT JOIN since USING (file, sha) WHERE sha IS NOT NULL"))
def commits_since_rank(spark, d):
    return _since(spark, d)


@query(V("drift", body="SELECT id, file, level FROM drift"))
def drift_levels(spark, d):
    return _drift(spark, d)


@query(V("drift", body="SELECT level, count(*) AS nodes FROM drift GROUP BY 1"))
def drift_by_level(spark, d):
    return _drift(spark, d).groupBy("level").agg(F.count("*").alias("nodes"))


@query(V("worst", body="SELECT file, drift FROM worst"))
def worst_drift(spark, d):
    return freshness.worst_by_file(_drift(spark, d))


@query(V("drift", "edges", body="SELECT src, dst, kind, coalesce(level = 'fresh', verified) AS verified FROM edges LEFT JOIN drift ON id = src"))
def edges_verified(spark, d):
    return freshness.verified(S.edges(spark, d), _drift(spark, d)).select("src", "dst", "kind", "verified")


@query(V("drift", "edges", body="SELECT id, coalesce(level, CASE WHEN id IN (SELECT src FROM edges WHERE NOT verified UNION ALL SELECT dst FROM edges WHERE NOT verified) THEN 'committed' END) AS drift FROM nodes LEFT JOIN (SELECT id, level FROM drift WHERE file IN (SELECT file FROM known)) USING (id)"))
def drift_fallback(spark, d):
    """What is shown if only nodes of files that are there were looked at."""
    looked = _drift(spark, d).join(S.known(spark, d), "file", "left_semi")
    return freshness.shown_drift(S.nodes(spark, d), looked, S.edges(spark, d))


@query(V("drift", body="SELECT id, CASE WHEN predicate IS NULL THEN '' WHEN level = 'broken' THEN 'broken' WHEN level = 'fresh' THEN 'holds' ELSE 'unverified' END AS trust FROM nodes LEFT JOIN (SELECT id, level FROM drift) USING (id) WHERE kind = 'decision'"))
def claim_trust(spark, d):
    rows = S.nodes(spark, d).where("kind = 'decision'").select("id", "predicate").join(_drift(spark, d).select("id", "level"), "id", "left")
    return rows.select("id", notes.trust(F.col("level"), F.col("predicate")).alias("trust"))


# Serves.
@query(V("blast", body="SELECT file, dependent, kind, importance, rank::INT AS rank FROM blast"))
def blast_ranked(spark, d):
    return serving.blast(S.nodes(spark, d), S.edges(spark, d))


@query(V("depends", body="SELECT file, target, kind, rank::INT AS rank FROM depends"))
def depends_ranked(spark, d):
    return serving.dependencies(S.nodes(spark, d), S.edges(spark, d)).select("file", "target", "kind", "rank")


@query(V("tasks", body="SELECT file, node_id, title, rank::INT AS rank FROM open_tasks"))
def open_tasks(spark, d):
    return serving.open_tasks(S.nodes(spark, d), S.edges(spark, d))


@query(V("warns", body="SELECT file, node_id, kind, title, rank::INT AS rank FROM warns"))
def landmines(spark, d):
    return serving.landmines(S.nodes(spark, d), S.edges(spark, d), S.targets(spark, d)).drop("why")


def _ids(column, *fields):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",")


@query(V("blast", "depends", "tasks", "warns", "why", "worst", body="""
, syms AS (SELECT file, string_agg(id, ',' ORDER BY line NULLS FIRST, id) AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line NULLS FIRST, id) AS r FROM filed WHERE kind = 'code-symbol') WHERE r <= 30 GROUP BY 1),
told AS (SELECT w.file, string_agg(w.node_id || coalesce(':' || level, ''), ',' ORDER BY w.rank) AS why FROM why w LEFT JOIN drift ON id = w.node_id WHERE NOT EXISTS (SELECT 1 FROM warns x WHERE x.file = w.file AND x.node_id = w.node_id) GROUP BY 1)
SELECT file, file IN (SELECT file FROM filed) OR file IN (SELECT file FROM why) AS known, coalesce(symbols, '') AS symbols, coalesce(why, '') AS why, coalesce(w.l, '') AS warns, coalesce(p.l, '') AS depends_on, coalesce(b.l, '') AS breaks, coalesce(o.l, '') AS open_tasks, drift
FROM targets LEFT JOIN syms USING (file) LEFT JOIN told USING (file) LEFT JOIN worst USING (file)
LEFT JOIN (SELECT file, string_agg(node_id, ',' ORDER BY rank) AS l FROM warns GROUP BY 1) w USING (file) LEFT JOIN (SELECT file, string_agg(target || ':' || kind, ',' ORDER BY rank) AS l FROM depends GROUP BY 1) p USING (file)
LEFT JOIN (SELECT file, string_agg(dependent || ':' || kind, ',' ORDER BY rank) AS l FROM blast GROUP BY 1) b USING (file) LEFT JOIN (SELECT file, string_agg(node_id, ',' ORDER BY rank) AS l FROM open_tasks GROUP BY 1) o USING (file)"""))
def brief(spark, d):
    """Everything about a file before it is edited."""
    b = serving.brief(S.nodes(spark, d), S.edges(spark, d), S.anchors(spark, d), _drift(spark, d), S.targets(spark, d))
    return b.select("file", "known", _ids("symbols", "node_id").alias("symbols"), _ids("why", "node_id", "drift").alias("why"), _ids("warns", "node_id").alias("warns"), _ids("depends_on", "target", "kind").alias("depends_on"), _ids("breaks", "dependent", "kind").alias("breaks"), _ids("open_tasks", "node_id").alias("open_tasks"), "drift")


_CODE = r"""code_files AS (SELECT DISTINCT file FROM filed WHERE kind = 'code-symbol' AND file IN (SELECT file FROM known) AND regexp_matches(lower(file), '\.(py|ts)$') AND NOT regexp_matches(file, '^tests/') AND NOT regexp_matches(file, '/__init__\.py$'))"""


@query(V("tree", "nodes", "edges", "importance", body=f", {_CODE} SELECT file, importance FROM code_files JOIN weights USING (file) WHERE file NOT IN (SELECT file FROM edges e JOIN filed f ON f.id = dst WHERE e.kind IN ('depends_on', 'implements', 'guarded_by', 'calls')) ORDER BY importance, file LIMIT 50"))
def dead_files(spark, d):
    """Source files that nothing leads to: here, where notes lead to most files, few or none."""
    nodes = S.nodes(spark, d)
    return serving.dead(nodes, S.edges(spark, d), S.known(spark, d)).join(serving.file_importance(nodes), "file").orderBy("importance", "file").limit(50).select("file", "importance")


@query(V("tree", "ties", "importance", body=f", {_CODE} SELECT file, importance FROM code_files JOIN weights USING (file) WHERE file NOT IN (SELECT b FROM ties WHERE kind IN ('depends_on', 'calls') AND a LIKE 'tests/%' UNION ALL SELECT a FROM ties WHERE kind IN ('depends_on', 'calls') AND b LIKE 'tests/%') ORDER BY importance DESC, file LIMIT 50"))
def untested_files(spark, d):
    nodes = S.nodes(spark, d)
    return serving.untested(nodes, S.edges(spark, d), S.known(spark, d)).join(serving.file_importance(nodes), "file").orderBy(F.desc("importance"), "file").limit(50).select("file", "importance")


@query(V("nodes", "edges", "ranks", "touched", body="""
, refs AS (SELECT DISTINCT n.id, n.title, n.sha, f.file FROM nodes n JOIN edges e ON src = n.id JOIN filed f ON f.id = dst WHERE n.kind IN ('lesson', 'decision') AND (list_contains(n.facets, 'foundation') OR n.title ILIKE 'ADR-%' OR n.title ILIKE 'ADR %') AND f.kind = 'code-symbol'),
moved AS (SELECT r.id, r.title, r.sha, r.file, count(*) AS n FROM refs r JOIN ranks x USING (sha) JOIN touched t ON t.file = r.file JOIN ranks y ON y.sha = t.sha WHERE y.rank < x.rank GROUP BY 1, 2, 3, 4)
SELECT id AS node_id, title, sha, count(*) AS files, sum(n)::BIGINT AS score, string_agg(file || ':' || n, ',' ORDER BY n DESC, file) AS stale_files FROM moved GROUP BY 1, 2, 3 HAVING max(n) >= 2 ORDER BY score DESC, files DESC, node_id LIMIT 20"""))
def stale_adrs(spark, d):
    found = serving.stale_decisions(S.nodes(spark, d), S.edges(spark, d), S.touched(spark, d), freshness.commit_rank(S.commits(spark, d)))
    return found.withColumn("stale_files", _ids("stale_files", "file", "commits_since"))


@query(V("nodes", body="""
, d AS (SELECT id, title, importance, CASE WHEN regexp_extract(title, '^ADR[- ](\\d+)', 1) <> '' THEN regexp_extract(title, '^ADR[- ](\\d+)', 1)::INT WHEN kind = 'decision' THEN -1 END AS n FROM nodes WHERE kind IN ('lesson', 'decision') AND (title ILIKE 'ADR-%' OR title ILIKE 'ADR %' OR kind = 'decision' OR list_contains(facets, 'foundation'))),
founding AS (SELECT id, title FROM d WHERE n >= 0 ORDER BY n, id DESC LIMIT 2), newest AS (SELECT id, title FROM d WHERE n IS NOT NULL AND id NOT IN (SELECT id FROM founding) ORDER BY n DESC, id DESC LIMIT 6)
SELECT id AS node_id, title, 'founding' AS slot FROM founding UNION ALL SELECT id, title, 'newest' FROM newest"""))
def must_know(spark, d):
    return serving.must_know(S.nodes(spark, d))


@query(V("drift", body="SELECT count(DISTINCT file) FILTER (kind = 'code-symbol') AS files, count(*) FILTER (kind IN ('lesson', 'decision')) AS lessons, count(*) FILTER (kind = 'task' AND NOT list_has_any(facets, ['done', 'dropped', 'deferred'])) AS open_tasks, count(*) FILTER (kind = 'commit') AS commits, count(*) FILTER (level = 'broken') AS broken FROM nodes LEFT JOIN (SELECT id, level FROM drift) USING (id)"))
def onboarding_counts(spark, d):
    rows = S.nodes(spark, d).join(_drift(spark, d).select("id", "level"), "id", "left")
    opened = (F.col("kind") == "task") & (notes.status(F.col("facets"), notes.ENDED_FIRST) == "open")
    return rows.agg(F.countDistinct(F.when(F.col("kind") == "code-symbol", F.col("file"))).alias("files"), F.count_if(F.col("kind").isin("lesson", "decision")).alias("lessons"), F.count_if(opened).alias("open_tasks"), F.count_if(F.col("kind") == "commit").alias("commits"), F.count_if(F.col("level") == "broken").alias("broken"))


@query(V("drift", body="SELECT id AS node_id, title, file, predicate FROM nodes JOIN (SELECT id, level FROM drift) USING (id) WHERE level = 'broken' ORDER BY importance DESC, id DESC"))
def broken_claims(spark, d):
    """All claims that no longer hold, the most important first."""
    rows = S.nodes(spark, d).join(_drift(spark, d).where("level = 'broken'").select("id"), "id")
    return rows.orderBy(F.desc("importance"), F.desc("id")).select(F.col("id").alias("node_id"), "title", "file", "predicate")


@query(V("blast", "tasks", "importance", "touched", body="""
, r AS (SELECT file, coalesce(importance, 0) AS importance, (SELECT count(*) FROM blast b WHERE b.file = t.file) AS dependents, (SELECT count(*) FROM open_tasks o WHERE o.file = t.file) AS open_tasks FROM (SELECT DISTINCT file FROM touched WHERE sha IN (SELECT max(o_orderkey) FROM orders)) t LEFT JOIN weights USING (file))
SELECT file, importance, dependents, open_tasks, array_to_string(list_filter([CASE WHEN importance >= 4 THEN 'load-bearing' END, CASE WHEN dependents >= 3 THEN dependents || ' dependents' END, CASE WHEN open_tasks > 0 THEN 'open task' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r WHERE importance >= 4 OR dependents >= 3 OR open_tasks > 0"""))
def review(spark, d):
    """What to look twice at in the newest order's files."""
    last = B.table(spark, d, "orders").agg(F.max("o_orderkey").alias("sha"))
    files = S.touched(spark, d).join(F.broadcast(last), "sha")  # one row
    return serving.review(S.nodes(spark, d), S.edges(spark, d), files).withColumn("reasons", F.array_join("reasons", ","))


@query(V("ties", "worst", "targets", "edges", body="""
, pairs AS (SELECT a AS target, b AS file, dst AS node, verified FROM ties WHERE kind = 'co_changed' UNION ALL SELECT b, a, src, verified FROM ties WHERE kind = 'co_changed'),
deg AS (SELECT target AS file, count(DISTINCT file) AS partner_degree FROM pairs GROUP BY 1),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY co_degree DESC, file) AS r FROM (SELECT target, p.file, count(DISTINCT node) AS co_degree, bool_and(verified) AS edge_verified FROM pairs p JOIN targets t ON t.file = target GROUP BY 1, 2)) WHERE r <= 8),
tied AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM ties WHERE kind IN ('depends_on', 'implements', 'guarded_by') UNION ALL SELECT b, a FROM ties WHERE kind IN ('depends_on', 'implements', 'guarded_by'))),
scope AS (SELECT DISTINCT target, file FROM (SELECT target, file FROM near UNION ALL SELECT file, file FROM targets)),
bound AS (SELECT target, id FROM (SELECT target, n.id, row_number() OVER (PARTITION BY target ORDER BY importance DESC NULLS LAST, n.id DESC) AS r FROM (SELECT DISTINCT target, src AS id FROM edges e JOIN filed f ON f.id = dst JOIN scope s ON s.file = f.file WHERE e.kind IN ('decided_by', 'guarded_by', 'supersedes', 'warns_about')) x JOIN nodes n ON n.id = x.id WHERE n.id NOT IN (SELECT dst FROM edges WHERE kind = 'supersedes')) WHERE r = 1)
SELECT near.target, near.file, CASE WHEN tied.a IS NULL THEN 'co-change only' ELSE 'import + co-change' END AS confidence, co_degree, partner_degree, edge_verified, drift AS partner_drift, bound.id AS bound_by FROM near LEFT JOIN deg USING (file) LEFT JOIN tied ON a = near.target AND b = near.file LEFT JOIN worst USING (file) LEFT JOIN bound ON bound.target = near.target"""))
def moves_with(spark, d):
    nodes = graph.written(S.nodes(spark, d))
    return serving.neighborhood(nodes, S.edges(spark, d), _drift(spark, d, nodes), S.targets(spark, d))


@query("WITH RECURSIVE " + V("nodes", "edges", body="")[5:] + """, p AS (SELECT dst AS old, src AS new FROM edges WHERE kind = 'supersedes'), w(node, head, steps) AS (SELECT old, new, 1 FROM p UNION SELECT node, new, steps + 1 FROM w JOIN p ON head = old WHERE steps < 16),
h AS (SELECT node, arg_max(head, (steps, head)) AS head FROM w GROUP BY 1)
SELECT id AS node_id, head AS superseded_by, id IN (SELECT src FROM edges WHERE kind = 'warns_about') AS became_landmine FROM nodes LEFT JOIN h ON node = id WHERE kind IN ('decision', 'lesson')""")
def precedent_fate(spark, d):
    return serving.fate(S.nodes(spark, d), S.edges(spark, d))


@query(V("nodes", body="""
, asked AS (SELECT target, regexp_replace(regexp_replace(trim(replace(target, '\\', '/')), '^\\./', ''), '/+$', '') AS t FROM (SELECT './' || file || '/' AS target FROM filed WHERE id % 100 = 0 AND kind = 'code-symbol' UNION SELECT upper(symbol) FROM nodes WHERE id % 150 = 0 AND kind = 'code-symbol' UNION SELECT 'no/such.py' UNION SELECT 'nothing')),
k AS (SELECT target, t AS file FROM asked WHERE t IN (SELECT file FROM filed)), names AS (SELECT lower(symbol) AS low, file FROM filed WHERE kind = 'code-symbol' UNION SELECT lower(title), file FROM filed WHERE kind = 'code-symbol'),
n AS (SELECT DISTINCT target, file FROM asked JOIN names ON low = lower(t) WHERE target NOT IN (SELECT target FROM k))
SELECT target, file FROM k UNION ALL SELECT target, file FROM n UNION ALL SELECT target, t FROM asked WHERE target NOT IN (SELECT target FROM k) AND target NOT IN (SELECT target FROM n) AND contains(t, '/')"""))
def target_files(spark, d):
    nodes = S.nodes(spark, d)
    code = serving.with_files(nodes).where("kind = 'code-symbol'")
    asked = code.where("id % 100 = 0").select(F.concat(F.lit("./"), "file", F.lit("/")).alias("target")).unionByName(code.where("id % 150 = 0").select(F.upper("symbol").alias("target"))).unionByName(spark.createDataFrame([("no/such.py",), ("nothing",)], "target string")).distinct()
    return serving.target_files(nodes, asked)


@query(V("ties", "importance", "tasks", body="""
SELECT file, coalesce(breaks, 0) AS breaks, coalesce(depends, 0) AS depends, coalesce(symbols, 0) AS symbols, coalesce(n, 0) AS open_tasks FROM (SELECT DISTINCT file FROM filed) LEFT JOIN (SELECT b AS file, count(*) AS breaks FROM ties WHERE tie > 0 GROUP BY 1) USING (file) LEFT JOIN (SELECT a AS file, count(*) AS depends FROM ties WHERE tie > 0 GROUP BY 1) USING (file)
LEFT JOIN (SELECT file, count(DISTINCT id) AS symbols FROM filed WHERE kind = 'code-symbol' AND (symbol IS NOT NULL OR line IS NOT NULL) GROUP BY 1) USING (file) LEFT JOIN (SELECT f.file, count(DISTINCT src) AS n FROM edges e JOIN nodes t ON t.id = src JOIN filed f ON f.id = dst WHERE e.kind = 'relates_to' AND t.kind = 'task' AND NOT list_has_any(t.facets, ['done', 'dropped', 'deferred']) GROUP BY 1) USING (file)"""))
def touches(spark, d):
    return serving.touches(S.nodes(spark, d), S.edges(spark, d))


_GRAPH = """
, fam AS (SELECT DISTINCT a, b, CASE WHEN kind IN ('depends_on', 'implements') THEN 'depends' WHEN kind = 'co_changed' THEN 'co' WHEN kind IN ('guarded_by', 'warns_about') THEN 'guards' ELSE 'relates' END AS family FROM ties),
degree AS (SELECT file, count(*) AS degree FROM (SELECT a AS file FROM fam UNION ALL SELECT b FROM fam) GROUP BY 1),
shown AS (SELECT file, w.importance, coalesce(degree, 0) AS degree, file IN (SELECT b FROM fam WHERE family = 'guards') AS guarded, coalesce(l, 0) AS lessons, coalesce(t, 0) AS tasks, CASE drift WHEN 'committed' THEN 'moved' WHEN 'uncommitted' THEN 'moved' WHEN 'broken' THEN 'broken' ELSE 'fresh' END AS freshness
  FROM weights w LEFT JOIN degree USING (file) LEFT JOIN worst USING (file) LEFT JOIN (SELECT file, count(*) FILTER (kind = 'lesson') AS l, count(*) FILTER (kind = 'task') AS t FROM filed GROUP BY 1) USING (file) ORDER BY w.importance + 8 * coalesce(degree, 0) DESC, file LIMIT 140)
"""


@query(V("ties", "importance", "worst", body=_GRAPH + "SELECT * FROM shown"))
def graph_files(spark, d):
    files, _ = _file_graph(spark, d)
    return files.select("file", "importance", "degree", "guarded", "lessons", "tasks", "freshness")


@query(V("ties", "importance", "worst", body=_GRAPH + "SELECT a, b, family FROM fam WHERE a IN (SELECT file FROM shown) AND b IN (SELECT file FROM shown)"))
def graph_edges(spark, d):
    return _file_graph(spark, d)[1]


@query(V("nodes", "edges", body="""
SELECT id AS node_id, kind, 2 AS version, (SELECT count(*) FROM edges e WHERE src = n.id AND dst NOT IN (SELECT id FROM nodes WHERE private)) AS edges FROM nodes n WHERE NOT coalesce(private, false)"""))
def store_rebuilt(spark, d):
    """What a version of the store has that newer rules have made of the first: here, its public part."""
    store = versions.Store(spark, f"{graph.shared_folder(spark)}/{uuid.uuid4().hex}")
    nodes = S.nodes(spark, d).select(F.col("id").alias("node_id"), "kind", "private")
    store.commit(store.head(), {"nodes": nodes, "edges": S.edges(spark, d).select("src", "dst", "kind")}, rules=1)
    head = store.opened(2, lambda base: dict(zip(("nodes", "edges"), writing.purge(base.table("nodes"), base.table("edges")), strict=True)))
    out = head.table("edges").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("edges"))
    return head.table("nodes").join(out, "node_id", "left").select("node_id", "kind", F.lit(head.version).alias("version"), F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


_SUFFIX_LIST = "[" + ", ".join(f"'{x}'" for x in links.SUFFIXES) + "]"
_FOLDER_LIST = "[" + ", ".join(f"'{x}'" for x in links.FOLDER_FILES) + "]"


@query(V("ties", "tree", body=rf"""
, bare AS (SELECT DISTINCT a, regexp_replace(a, '/?[^/]*$', '') AS folder, regexp_replace(regexp_replace(b, '\.[^./]+$', ''), '/__init__$', '') AS bare, (src + dst) % 4 AS style FROM ties WHERE kind = 'depends_on'),
asked AS (SELECT DISTINCT a AS path, folder, regexp_replace(folder, '/?[^/]*$', '') AS up, split_part(bare, '/', -1) AS base, regexp_replace(bare, '^src/', '') AS rest, bare, style,
  CASE style WHEN 0 THEN replace(bare, '/', '.') WHEN 1 THEN '@/' || regexp_replace(bare, '^src/', '') WHEN 2 THEN './' || split_part(bare, '/', -1) ELSE '..' || split_part(bare, '/', -1) END AS spec FROM bare),
ways AS (SELECT path, spec, unnest(l) AS name, unnest(range(len(l))) AS nth FROM (SELECT path, spec, list_transform(CASE style WHEN 0 THEN [bare, 'src/' || bare] WHEN 1 THEN list_concat(list_concat([folder || '/src/' || rest, folder || '/' || rest], [up || '/src/' || rest, up || '/' || rest]), ['src/' || rest, rest])
  WHEN 2 THEN [folder || '/' || base] ELSE [up || '/' || base] END, lambda x: regexp_replace(x, '^/', '')) AS l FROM asked)),
ext AS (SELECT file, list_position({_SUFFIX_LIST}, regexp_extract(file, '(\.[^./]+)$', 1)) AS e, regexp_replace(file, '\.[^./]+$', '') AS b FROM known),
names AS (SELECT file AS target, file AS name, 0 AS r FROM known UNION ALL SELECT file, b, e FROM ext WHERE e > 0 UNION ALL SELECT file, regexp_replace(b, '/?[^/]*$', ''), 100 * list_position({_FOLDER_LIST}, split_part(b, '/', -1)) + e FROM ext WHERE e > 0 AND list_position({_FOLDER_LIST}, split_part(b, '/', -1)) > 0)
SELECT path, spec, arg_min(target, (nth, r, target)) AS target FROM ways JOIN names USING (name) GROUP BY 1, 2"""))
def import_targets(spark, d):
    """Files that imports lead to, written in four ways: as a module, by an alias, relative to the file and to its package."""
    nodes, edges = S.nodes(spark, d), S.edges(spark, d)
    ties = serving.file_edges(nodes, edges, ("depends_on",))
    bare = F.regexp_replace(F.regexp_replace("b", r"\.[^./]+$", ""), "/__init__$", "")
    style, base = (F.col("src") + F.col("dst")) % 4, F.substring_index(bare, "/", -1)
    spec = F.when(style == 0, F.translate(bare, "/", ".")).when(style == 1, F.concat(F.lit("@/"), F.regexp_replace(bare, "^src/", ""))).when(style == 2, F.concat(F.lit("./"), base)).otherwise(F.concat(F.lit(".."), base))
    return links.resolved(ties.select(F.col("a").alias("path"), spec.alias("spec")), S.known(spark, d).select(F.col("file").alias("path")))


@query(V("nodes", body="SELECT author, count(*) AS lessons FROM nodes WHERE kind = 'lesson' AND author <> '' GROUP BY 1"))
def authors(spark, d):
    return S.nodes(spark, d).where("kind = 'lesson' and author <> ''").groupBy("author").agg(F.count("*").alias("lessons"))


@query(V("nodes", body="SELECT file, count(*) FILTER (kind IN ('lesson', 'decision')) AS lessons, count(*) FILTER (kind = 'lesson') AS lesson, count(*) FILTER (kind = 'task') AS task FROM filed WHERE kind IN ('lesson', 'decision', 'task') AND NOT private GROUP BY 1"))
def knowledge_by_file(spark, d):
    rows = serving.with_files(S.nodes(spark, d)).where("kind in ('lesson', 'decision', 'task') and not private")
    return rows.groupBy("file").agg(F.count_if(F.col("kind").isin("lesson", "decision")).alias("lessons"), F.count_if(F.col("kind") == "lesson").alias("lesson"), F.count_if(F.col("kind") == "task").alias("task"))


@query(V("blast", body="SELECT t.file, count(DISTINCT a) AS truth, count(DISTINCT dependent) AS caught FROM (SELECT b AS file, a FROM ties WHERE kind = 'depends_on') t LEFT JOIN blast ON blast.file = t.file AND dependent = a GROUP BY 1"))
def edge_corroboration(spark, d):
    """How many of a file's true dependents its blast radius shows."""
    nodes, edges = S.nodes(spark, d), S.edges(spark, d)
    truth = serving.file_edges(nodes, edges, ("depends_on",)).select(F.col("b").alias("file"), F.col("a").alias("dependent")).distinct()
    shown = serving.blast(nodes, edges).select("file", "dependent", F.lit(True).alias("shown"))
    return truth.join(shown, ["file", "dependent"], "left").groupBy("file").agg(F.count("*").alias("truth"), F.count_if("shown").alias("caught"))


@query(V("nodes", "edges", body="SELECT f.file, count(*) AS edges, count(*) * 12 // 4 AS tokens FROM edges e JOIN filed f ON f.id = src JOIN filed g ON g.id = dst WHERE e.kind = 'depends_on' AND f.file <> g.file GROUP BY 1"))
def refine_cost(spark, d):
    """What it would cost to have a model name the kinds of each file's edges: twelve characters an edge."""
    rows = serving.file_edges(S.nodes(spark, d), S.edges(spark, d), ("depends_on",)).groupBy(F.col("a").alias("file")).agg(F.count("*").alias("edges"))
    return rows.withColumn("tokens", text.tokens_of_chars(F.col("edges") * 12).cast("long"))


@query(V("nodes", body="SELECT count(*) AS nodes, count(*) FILTER (kind = 'lesson') AS lessons, (SELECT count(*) FROM orders) AS commits, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders) AS head FROM nodes"))
def pulse(spark, d):
    commits = S.commits(spark, d).agg(F.count("*").alias("commits"), F.max_by("sha", F.struct("ts", "sha")).alias("head"))
    return S.nodes(spark, d).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "lesson").alias("lessons")).crossJoin(F.broadcast(commits))  # one row each


# Tasks.
@query(V("nodes", body="SELECT id AS node_id, CASE WHEN list_contains(facets, 'open') THEN 'open' WHEN list_contains(facets, 'done') THEN 'done' ELSE 'open' END AS status, CASE WHEN list_contains(facets, 'done') THEN 'done' ELSE 'open' END AS shown, (date_diff('day', created, TIMESTAMP '2000-01-01')) AS age_days, created < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY AS stale FROM nodes WHERE kind = 'task'"))
def task_status(spark, d):
    rows = S.nodes(spark, d).where("kind = 'task'")
    day = F.lit("2000-01-01").cast("timestamp_ntz")
    return rows.select(F.col("id").alias("node_id"), notes.status(F.col("facets")).alias("status"), notes.status(F.col("facets"), notes.ENDED_FIRST).alias("shown"), F.datediff(day, "created").cast("long").alias("age_days"), (F.col("created") < day - F.expr("interval 30 days")).alias("stale"))


# The write path.
_LEFT = "gone AS (SELECT id FROM nodes WHERE {what})"


def _gone_edges(spark, d, gone):
    _, edges, _ = maintenance.without_nodes(gone, S.nodes(spark, d), S.edges(spark, d), S.anchors(spark, d))
    return edges.select("src", "dst", "kind")


@query(V("nodes", "edges", body=", " + _LEFT.format(what="origin = 'power'") + " SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"))
def delete_origin(spark, d):
    return _gone_edges(spark, d, maintenance.of_origin(S.nodes(spark, d), "power"))


@query(V("nodes", "edges", "targets", body="SELECT id FROM nodes WHERE NOT (kind = 'code-symbol' AND origin = 'bootstrap' AND replace(file, '\\', '/') IN (SELECT file FROM targets))"))
def delete_file_symbols(spark, d):
    gone = maintenance.symbols_of_files(S.nodes(spark, d), S.targets(spark, d))
    return maintenance.without_nodes(gone, S.nodes(spark, d), S.edges(spark, d), S.anchors(spark, d))[0].select("id")


@query(V("nodes", "anchors", body="SELECT node_id, term FROM anchors WHERE node_id NOT IN (SELECT id FROM nodes WHERE kind = 'task')"))
def delete_tasks(spark, d):
    nodes, edges = S.nodes(spark, d), S.edges(spark, d)
    return maintenance.without_nodes(maintenance.tasks_of(nodes, edges), nodes, edges, S.anchors(spark, d))[2].select("node_id", "term")


@query(V("nodes", body="SELECT id, origin = 'bootstrap' AS refused FROM nodes"))
def forget(spark, d):
    nodes = S.nodes(spark, d)
    return maintenance.forgettable(nodes, nodes.select("id"))


_INCOMING = f"incoming AS (SELECT o_orderkey + {S.NOTE} AS node_id, ' ' || o_orderpriority || ' ' AS term FROM orders UNION ALL SELECT o_orderkey + {S.NOTE}, upper(split_part(o_orderpriority, '-', 2)) FROM orders UNION ALL SELECT o_orderkey + {S.NOTE}, '  ' FROM orders)"


def _incoming(spark, d):
    own = B.table(spark, d, "orders").select((F.col("o_orderkey") + S.NOTE).alias("node_id"), "o_orderpriority")
    given = F.array(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")), F.upper(F.substring_index("o_orderpriority", "-", -1)), F.lit("  "))
    return own.select("node_id", F.explode(given).alias("term"))


@query(V("anchors", body=f", {_INCOMING} SELECT DISTINCT node_id, lower(trim(term)) AS term FROM incoming WHERE trim(term) <> '' EXCEPT SELECT node_id, term FROM anchors"))
def anchors_added(spark, d):
    return maintenance.add_anchors(S.anchors(spark, d), _incoming(spark, d))


@query(V("anchors", body="SELECT node_id, term FROM anchors WHERE term <> 'high'"))
def anchors_taken_back(spark, d):
    terms = S.anchors(spark, d)
    return maintenance.take_back_anchors(terms, terms.where("term = 'high'").select("node_id", F.upper("term").alias("term")))


@query(V("nodes", body=f"SELECT o_orderkey + {S.NOTE} AS src, 'relates_to' AS kind, min(id) AS known FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 300 + 1 LEFT JOIN (SELECT id, title FROM nodes WHERE kind = 'code-symbol') ON title = p_name WHERE o_orderkey % 50 = 0 GROUP BY 1"))
def edges_to_targets(spark, d):
    """Edges from notes to symbols by title; a title that nothing has yet gets a new node."""
    asked = B.table(spark, d, "orders").where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + S.NOTE).alias("src"), (F.col("o_orderkey") % 300 + 1).alias("p_partkey"))
    wanted = asked.join(B.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left").select("src", F.lit("relates_to").alias("kind"), F.coalesce(F.concat(F.lit(" "), "p_name"), F.lit("a new one")).alias("target"))
    edges, _ = maintenance.edges_to_targets(S.nodes(spark, d), wanted)
    return edges.select("src", "kind", F.when(F.col("dst") >= 0, F.col("dst")).alias("known"))


@query(V("nodes", body="SELECT file, arg_min(id, (line, id)) AS id FROM filed WHERE kind = 'code-symbol' GROUP BY 1"))
def representatives(spark, d):
    return maintenance.representatives(S.nodes(spark, d))


@query(V("ties", body=", rep AS (SELECT file, arg_min(id, (line, id)) AS id FROM filed WHERE kind = 'code-symbol' GROUP BY 1) SELECT DISTINCT x.id AS src, y.id AS dst, 'depends_on' AS kind FROM ties JOIN rep x ON x.file = a JOIN rep y ON y.file = b WHERE ties.kind = 'implements' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = x.id AND e.dst = y.id AND e.kind = 'depends_on')"))
def dependency_edges(spark, d):
    nodes, edges = S.nodes(spark, d), S.edges(spark, d)
    pairs = serving.file_edges(nodes, edges, ("implements",)).select(F.col("a").alias("from"), F.col("b").alias("to"))
    return maintenance.file_edges(nodes, edges, pairs)


@query(V("nodes", "edges", body="""
, aff AS (SELECT id AS task, replace(file, '\\', '/') AS file FROM nodes WHERE kind = 'task' AND file IS NOT NULL UNION SELECT id, 'conf/app.yml' FROM nodes WHERE kind = 'task' AND id % 100 = 3), rep AS (SELECT file, arg_min(id, (line, id)) AS id FROM filed WHERE kind = 'code-symbol' GROUP BY 1)
SELECT task AS src, rep.id AS known, 'relates_to' AS kind FROM aff LEFT JOIN rep USING (file) WHERE rep.id IS NULL OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = task AND e.dst = rep.id AND e.kind = 'relates_to')"""))
def task_links(spark, d):
    nodes = S.nodes(spark, d)
    tasks = nodes.where("kind = 'task'")
    affects = tasks.where("file is not null").select(F.col("id").alias("task"), "file").unionByName(tasks.where("id % 100 = 3").select(F.col("id").alias("task"), F.lit("conf\\app.yml").alias("file")))
    links, _ = maintenance.task_links(nodes, S.edges(spark, d), affects)
    return links.select("src", F.when(F.col("dst") >= 0, F.col("dst")).alias("known"), "kind")


@query("SELECT node_id, sum(useful)::BIGINT AS useful, sum(missed)::BIGINT AS missed FROM (SELECT doc_id AS node_id, quality AS useful, toxic AS missed FROM labels UNION ALL SELECT user_id, 1, 0 FROM events WHERE event_type = 'click') GROUP BY 1")
def feedback_added(spark, d):
    given = B.table(spark, d, "labels").select(F.col("doc_id").alias("node_id"), F.col("quality").alias("useful"), F.col("toxic").alias("missed"))
    return maintenance.add_feedback(given, B.table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("node_id"), F.lit(1).alias("useful"), F.lit(0).alias("missed")))


@query(V("nodes", body="SELECT id, CASE WHEN kind = 'code-symbol' THEN round(least(100.0, (id % 40 + 1) * (1 + 0.2 * greatest(-5.0, least(5.0, coalesce(u, 0) - coalesce(m, 0))) / 5)), 1) ELSE importance END AS importance FROM nodes LEFT JOIN (SELECT doc_id AS id, sum(quality) AS u, sum(toxic) AS m FROM labels GROUP BY 1) USING (id)"))
def importance_persisted(spark, d):
    nodes = S.nodes(spark, d)
    ranked = nodes.where("kind = 'code-symbol'").select(F.col("id").alias("node"), (F.col("id") % 40 + 1).cast("double").alias("importance"))
    feedback = B.table(spark, d, "labels").select(F.col("doc_id").alias("node_id"), F.col("quality").alias("useful"), F.col("toxic").alias("missed"))
    return maintenance.persist_importance(nodes, ranked, feedback).select("id", "importance")


@query(V("edges", body="SELECT src, dst, CASE WHEN hit THEN 'implements' ELSE kind END AS kind, CASE WHEN hit THEN kind END AS refined_from, CASE WHEN hit THEN 9 ELSE run END AS run FROM (SELECT *, kind = 'depends_on' AND verified AS hit FROM edges)"))
def refine_kinds(spark, d):
    edges = S.edges(spark, d)
    labels = edges.where("verified and kind = 'depends_on'").select("src", "dst", F.lit("implements").alias("kind")).unionByName(edges.where("not verified").select("src", "dst", F.lit("made up").alias("kind")))
    return maintenance.refine(edges, labels, ("implements", "guarded_by"), 9).select("src", "dst", "kind", "refined_from", "run")


@query(V("edges", body="SELECT src, dst, kind FROM edges"))
def unrefine_kinds(spark, d):
    edges = graph.written(S.edges(spark, d))  # edges and labels read them
    labels = edges.select("src", "dst", F.lit("implements").alias("kind"))
    return maintenance.unrefine(maintenance.refine(edges, labels, ("implements",), 9), 9).select("src", "dst", "kind")


@query(V("nodes", "targets", body="SELECT id, title FROM nodes WHERE NOT (kind = 'code-symbol' AND replace(file, '\\', '/') IN (SELECT file FROM targets)) UNION ALL SELECT id, title || ' v2' FROM filed JOIN targets USING (file) WHERE kind = 'code-symbol' AND importance > 20"))
def update_files(spark, d):
    """A change of the files asked about: their symbols are read again, those of little importance are gone."""
    nodes = S.nodes(spark, d)
    changed = S.targets(spark, d).withColumn("deleted", F.lit(False))
    fresh = nodes.where("kind = 'code-symbol' and importance > 20").withColumn("title", F.concat("title", F.lit(" v2")))
    return maintenance.update_files(nodes, S.edges(spark, d), S.anchors(spark, d), changed, fresh)[0].select("id", "title")


# Texts.
_MESSAGE = r"""messages AS (SELECT o_orderkey AS sha, CASE o_orderkey % 4 WHEN 0 THEN 'feat(' || lower(o_orderstatus) || ', x): new' WHEN 1 THEN 'fix: it' WHEN 2 THEN 'note-anchors: odd' ELSE 'some words' END || chr(10) || chr(10) || 'because of ' || o_orderpriority || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Note-anchors: a, ' || o_orderpriority || chr(10) || 'Note-edge: relates_to -> part ' || o_custkey || chr(10) || 'Note-edge: nothing' || chr(10) ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'Note-why: it had to' || chr(10) ELSE '' END || 'Signed-off-by: someone' AS m FROM orders)"""


def _messages(spark, d):
    k = F.col("o_orderkey")
    first = F.when(k % 4 == 0, F.concat(F.lit("feat("), F.lower("o_orderstatus"), F.lit(", x): new"))).when(k % 4 == 1, "fix: it").when(k % 4 == 2, "note-anchors: odd").otherwise("some words")
    linked = F.when(k % 2 == 0, F.concat(F.lit("Note-anchors: a, "), "o_orderpriority", F.lit("\nNote-edge: relates_to -> part "), F.col("o_custkey").cast("string"), F.lit("\nNote-edge: nothing\n"))).otherwise("")
    why = F.when(k % 3 == 0, "Note-why: it had to\n").otherwise("")
    return B.table(spark, d, "orders").select(k.alias("sha"), F.concat(first, F.lit("\n\nbecause of "), "o_orderpriority", F.lit("\n"), linked, why, F.lit("Signed-off-by: someone")).alias("m"))


@query(f"""WITH {_MESSAGE} SELECT sha, nullif(trim(regexp_extract(m, '(?m)^Note-anchors:\\s*(.+)$', 1)), '') AS anchors, CASE WHEN contains(m, 'Note-why') THEN 'it had to' WHEN m LIKE 'note-anchors%' THEN nullif(trim(regexp_extract(m, '(?m)^Note-anchors:\\s*(.+)$', 1)), '') ELSE split_part(m, chr(10), 1) END AS title,
CASE WHEN contains(m, '->') THEN 'relates_to:' || regexp_extract(m, '-> (.+)', 1) ELSE '' END AS edges, regexp_extract(m, '(because of .+)', 1) AS body, CASE WHEN m LIKE 'feat(%' THEN substr(m, 6, 1) END AS feature, CASE WHEN m LIKE 'feat%' THEN 'feature' WHEN m LIKE 'fix%' THEN 'bugfix' ELSE '' END AS facets FROM messages""")
def commit_notes(spark, d):
    """What commit messages say by their trailers, and which facets and feature their titles give."""
    m = F.col("m")
    first = F.substring_index(m, "\n", 1)
    return _messages(spark, d).select(
        "sha", notes.trailer(m, "anchors").alias("anchors"), notes.note_title(m).alias("title"), _ids(notes.trailer_edges(m), "kind", "target").alias("edges"), notes.explanation(m).alias("body"),
        notes.feature(first).alias("feature"), F.array_join(notes.commit_facets(first, F.array(F.lit("a.py"))), ",").alias("facets"),
    )


@query(V("touched", body="SELECT sha, string_agg(file, ',' ORDER BY file) FILTER (file NOT LIKE '%.md') AS sources, coalesce(min(file) FILTER (file NOT LIKE '%.md'), min(file)) AS main FROM touched GROUP BY 1"))
def commit_main_file(spark, d):
    files = S.touched(spark, d).groupBy("sha").agg(F.sort_array(F.collect_list("file")).alias("files"))
    sources = notes.sources_only(F.col("files"))
    return files.select("sha", F.when(F.size(sources) > 0, F.array_join(sources, ",")).alias("sources"), notes.main_file(F.col("files")).alias("main"))


@query(r"""SELECT doc_id AS node_id, coalesce(list_sum(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda s: s <> '' AND NOT regexp_matches(s, '^#{1,6}\s') AND NOT regexp_matches(s, '^[-*_]{3,}\s*$') AND NOT regexp_matches(s, '^\[[^\]]*\]\([^)]*\)[.,;]?\s*$')), lambda s: length(s))), 0)::INT AS prose FROM documents""")
def own_prose(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), notes.own_prose(F.col("text")).alias("prose"))


# Retrieval with term counts and an edit's context.
_BOOSTED = "weighted AS (SELECT qid, node_id, hits, round(relevance * coalesce(list_max(list_transform(facets, lambda f: CASE f WHEN 'security' THEN 2.0 WHEN 'docs' THEN 0.7 WHEN 'chore' THEN 0.3 ELSE 1.0 END)), 1.0)::DOUBLE * CASE WHEN list_contains(facets, 'security') THEN 1.5 ELSE 1.0 END, 4) AS score FROM bm25 JOIN nodes USING (node_id) WHERE hits >= 2 AND NOT list_contains(facets, 'chore'))"


@query(f"WITH {B.SQL['nodes']}, {_POSTINGS}, {_TERMS}, {_BM25}, {_BOOSTED} SELECT qid, rank::INT AS rank, node_id, hits, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hits DESC, node_id) AS rank FROM weighted) WHERE rank <= 3")
def retrieve_in_context(spark, d):
    """Retrieval while a login file is edited: security counts for more, chores are silent."""
    nodes = B.nodes(spark, d)
    index = graph.cut(retrieval.postings(nodes))
    found = retrieval.bm25(retrieval.rarest_terms(retrieval.query_terms(B.queries(spark, d)), index), index).where("hits >= 2")
    boosted = notes.context_facet(F.lit("src/Login/auth.py"), {"auth": "security", "ui": "frontend"})
    rows = found.join(nodes.select("node_id", "facets"), "node_id").where(~F.arrays_overlap("facets", F.array(F.lit("chore"))))
    weight = scores.facet_weight(F.col("facets")) * F.when(F.array_contains("facets", boosted), 1.5).otherwise(1.0)
    return retrieval.top_rows(rows.withColumn("score", F.round(F.col("relevance") * weight, 4)), ["qid"], [F.desc("score"), F.desc("hits"), "node_id"], 3).select("qid", "rank", "node_id", "hits", "score")


@query("SELECT doc_id AS node_id, count(*) AS hits FROM (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)) WHERE w[i:i + 1] = ['of', 'the'] GROUP BY 1")
def phrase_hits(spark, d):
    """How often documents have a phrase of two words: tf over runs of terms."""
    low = F.lower("text")
    docs = B.table(spark, d, "documents").where(notes.phrase(F.split(low, " "), F.array(F.lit("of"), F.lit("the"))))
    return docs.select(F.col("doc_id").alias("node_id"), F.regexp_count(low, F.lit("(?:^|(?<= ))of the(?= |$)")).cast("long").alias("hits"))


@query(V("nodes", body=r"SELECT id, regexp_matches(lower(replace(file, '\', '/')), '^tests/|\.(spec|test)\.') AS test, regexp_matches(lower(replace(file, '\', '/')), '/__init__\.[a-z]+$') AS entry, regexp_matches(lower(file), '\.(py|ts)$') AS code, regexp_matches(replace(file, '\', '/'), '^docs/m1$') AS noise FROM nodes WHERE file IS NOT NULL"))
def path_kinds(spark, d):
    f = F.col("file")
    return S.nodes(spark, d).where("file is not null").select("id", paths.is_test(f).alias("test"), paths.is_entry(f).alias("entry"), paths.is_code(f).alias("code"), notes.is_noise(f).alias("noise"))


# Whole answers.
_RUN = "'-' || trim(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '-') || '-'"
_TRACKS_SQL = f"""
, idx AS (SELECT node_id, term FROM anchors UNION SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) FROM part),
asked AS (SELECT DISTINCT p_partkey AS qid, unnest(list_concat(string_split(lower(p_name), ' '), ['urgent', 'medium'])) AS term FROM part WHERE p_partkey % 400 = 0 UNION ALL SELECT 1, 'nothing'),
hit AS (SELECT qid, a.term AS qterm, node_id, i.term FROM (SELECT qid, term, {_RUN} AS wanted FROM asked) a JOIN (SELECT node_id, term, {_RUN} AS run FROM idx) i ON contains(run, wanted)),
tf AS (SELECT qid, qterm, node_id, count(*) AS tf FROM hit GROUP BY ALL), df AS (SELECT qid, qterm, count(*) AS df FROM tf GROUP BY ALL),
lengths AS (SELECT node_id, count(*) AS length FROM idx GROUP BY 1), stats AS (SELECT count(*) AS n, avg(length) AS av FROM lengths),
rel AS (SELECT qid, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.6 + 0.4 * length / av))) AS relevance FROM tf JOIN df USING (qid, qterm) JOIN lengths USING (node_id), stats GROUP BY 1, 2),
raw AS (SELECT qid, node_id, count(DISTINCT term) AS hits FROM hit GROUP BY 1, 2),
r AS (SELECT qid, node_id, hits, kind, title, file, importance, relevance, round(relevance * w, 2) AS weighted, round(relevance * w * CASE WHEN list_contains(facets, 'foundation') THEN 1.5 ELSE 1.0 END, 2) AS scored, round(relevance * CASE WHEN file LIKE 'tests/%' THEN 0.5 ELSE 1.0 END, 6) AS coded,
  CASE WHEN kind = 'code-symbol' THEN node_id::VARCHAR ELSE title || chr(1) || coalesce(file, '') END AS once FROM rel JOIN raw USING (qid, node_id) JOIN (SELECT *, CASE WHEN facets = ['docs'] THEN 0.7 ELSE 1.0 END::DOUBLE AS w FROM nodes) n ON n.id = node_id),
res AS (SELECT qid, 'result' AS track, row_number() OVER (PARTITION BY qid ORDER BY scored DESC, hits DESC, node_id) AS rank, node_id, file, scored AS relevance, hits FROM (SELECT *, row_number() OVER (PARTITION BY qid, once ORDER BY scored DESC, hits DESC, node_id) AS o FROM r WHERE hits >= 2) WHERE o = 1 QUALIFY rank <= 3),
code AS (SELECT qid, 'code' AS track, row_number() OVER (PARTITION BY qid ORDER BY coded DESC, importance DESC NULLS LAST, node_id) AS rank, node_id, file, round(relevance, 2) AS relevance, hits FROM r WHERE kind = 'code-symbol' QUALIFY rank <= 5),
know AS (SELECT qid, 'knowledge' AS track, row_number() OVER (PARTITION BY qid ORDER BY weighted DESC, node_id) AS rank, node_id, file, weighted AS relevance, hits FROM (SELECT *, row_number() OVER (PARTITION BY qid, once ORDER BY weighted DESC, node_id) AS o FROM r WHERE kind <> 'code-symbol') WHERE o = 1 QUALIFY rank <= 5),
heard AS (SELECT * FROM (SELECT * FROM res UNION ALL SELECT * FROM code UNION ALL SELECT * FROM know) WHERE qid IN (SELECT qid FROM res)), top AS (SELECT qid, replace(file, '\\', '/') AS file FROM heard WHERE track = 'code' AND rank = 1),
every AS (SELECT * FROM heard UNION ALL SELECT qid, 'blast', rank, NULL, dependent, importance, 0 FROM top JOIN blast USING (file) UNION ALL SELECT qid, 'task', rank, node_id, file, 0.0, 0 FROM top JOIN open_tasks USING (file) UNION ALL SELECT DISTINCT qid, 'silenced', 1, NULL::BIGINT, NULL, 0.0, 0 FROM asked WHERE qid NOT IN (SELECT qid FROM heard))
SELECT qid, track, rank::INT AS rank, node_id, every.file, relevance, hits, coalesce(level, CASE WHEN node_id IN (SELECT src FROM edges WHERE NOT verified UNION ALL SELECT dst FROM edges WHERE NOT verified) THEN 'committed' END) AS drift FROM every LEFT JOIN drift ON id = node_id"""


@query(V("anchors", "blast", "tasks", "drift", body=_TRACKS_SQL))
def retrieve_tracks(spark, d):
    """Retrieval with all its tracks, for the names of parts."""
    part = B.table(spark, d, "part")
    words = F.split(F.lower("p_name"), " ")
    index = S.anchors(spark, d).unionByName(part.select(F.col("p_partkey").alias("node_id"), F.explode(words).alias("term"))).distinct()
    asked = part.where("p_partkey % 400 = 0").select(F.col("p_partkey").alias("qid"), F.explode(F.concat(words, F.array(F.lit("urgent"), F.lit("medium")))).alias("term")).distinct()
    asked = asked.unionByName(spark.range(1).select(F.lit(1).cast("long").alias("qid"), F.lit("nothing").alias("term")))
    return reports.all_tracks(asked, S.nodes(spark, d), S.edges(spark, d), graph.cut(index), _drift(spark, d), boost="foundation")


@query("""WITH c AS (SELECT lower(o_orderstatus) AS feature, count(*) AS commits FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1), o AS (SELECT lower(o_orderstatus) AS feature, count(*) FILTER (o_orderkey % 4 = 1) AS decisions, count(*) FILTER (o_orderkey % 4 = 2 AND o_orderkey % 3 <> 0) AS open, count(*) FILTER (o_orderkey % 4 = 2 AND o_orderkey % 3 = 0) AS done FROM orders GROUP BY 1)
SELECT feature, commits, coalesce(decisions, 0) AS decisions, coalesce(open, 0) AS open, coalesce(done, 0) AS done FROM c LEFT JOIN o USING (feature)""")
def product_tree(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "commit").when(k % 4 == 1, "decision").when(k % 4 == 2, "task").otherwise("lesson")
    title = F.when(k % 4 == 0, F.concat(F.lit("feat("), "o_orderstatus", F.lit(", x): new"))).otherwise(F.concat(F.lit("About "), "o_orderstatus", F.lit(": more")))
    facets = F.when(k % 3 == 0, F.array(F.lit("open"), F.lit("done"))).otherwise(F.array(F.lit("open")))
    return reports.product_tree(B.table(spark, d, "orders").select(k.alias("id"), kind.alias("kind"), title.alias("title"), facets.alias("facets")))


@query(V("importance", "worst", "warns", body="SELECT file, coalesce(importance, 0.0) AS importance, drift, file IN (SELECT file FROM warns) AS landmine FROM targets LEFT JOIN weights USING (file) LEFT JOIN worst USING (file)"))
def annotated_files(spark, d):
    return serving.annotated(S.targets(spark, d), S.nodes(spark, d), S.edges(spark, d), _drift(spark, d)).select("file", "importance", "drift", "landmine")


@query(V("blast", "tasks", "importance", "targets", body=r"""
, r AS (SELECT file, coalesce(importance, 0) AS importance, (SELECT count(*) FROM blast b WHERE b.file = t.file) AS dependents, (SELECT count(*) FROM open_tasks o WHERE o.file = t.file) AS open_tasks FROM targets t LEFT JOIN weights USING (file)),
risk AS (SELECT file FROM r WHERE importance >= 4 OR dependents >= 3 OR open_tasks > 0)
SELECT file, CASE WHEN regexp_matches(lower(file), '\.(py|ts)$') THEN 'contains:handle_it' END AS "check", file IN (SELECT file FROM risk) AS risky FROM targets WHERE file IN (SELECT file FROM risk) OR regexp_matches(lower(file), '\.(py|ts)$')"""))
def before_commit(spark, d):
    files = S.targets(spark, d)
    added = files.select("file", F.posexplode(F.array(F.lit("x = 1"), F.lit("def handle_it(y):"), F.lit("LIMIT = 3"))).alias("at", "line"))
    return reports.before_commit(S.nodes(spark, d), S.edges(spark, d), files, added).select("file", "check", F.col("reasons").isNotNull().alias("risky"))


@query(V("nodes", "targets", body="SELECT id, file FROM filed JOIN targets USING (file) WHERE private"))
def leaks(spark, d):
    return reports.leaks(S.nodes(spark, d), S.targets(spark, d))


@query(V("nodes", "targets", body="SELECT file, id AS node_id, title FROM filed JOIN targets USING (file) WHERE kind = 'lesson'"))
def existing_lessons(spark, d):
    """The lessons that files have already, before more are asked for."""
    own = serving.with_files(S.nodes(spark, d)).where("kind = 'lesson'")
    return own.join(S.targets(spark, d), "file", "left_semi").select("file", F.col("id").alias("node_id"), "title")


@query(V("nodes", "edges", body="SELECT src AS task, string_agg(DISTINCT f.file, ',' ORDER BY f.file) AS files FROM edges e JOIN nodes t ON t.id = src JOIN filed f ON f.id = dst WHERE e.kind = 'relates_to' AND t.kind = 'task' GROUP BY 1"))
def task_affects(spark, d):
    return reports.affected(S.nodes(spark, d), S.edges(spark, d)).withColumn("files", F.array_join("files", ","))
