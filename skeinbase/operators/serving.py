"""Answers over the store, for many targets at once.

Nodes (id, kind, title, body, facets, file, symbol, line, sha, origin, importance, predicate, outcome),
edges (src, dst, kind, verified), anchors (node_id, term), drift (id, level).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import notes, paths, text
from ..functions.paths import normal
from . import freshness, graph
from .retrieval import top_rows

#: How hard a relation ties: the strongest one between two files counts.
TIES = {"depends_on": 5, "implements": 4, "guarded_by": 3, "relates_to": 2, "co_changed": 1}
STRUCTURE = ("depends_on", "implements", "guarded_by", "calls")
BINDING = ("decided_by", "guarded_by", "supersedes", "warns_about")
NO_KNOWLEDGE = ("code-symbol", "task", "file")


def with_files(nodes: DataFrame) -> DataFrame:
    """Nodes that have a file, its path normal."""
    return nodes.where("file is not null and file <> ''").withColumn("file", normal(F.col("file")))


def file_edges(nodes: DataFrame, edges: DataFrame, kinds=tuple(TIES)) -> DataFrame:
    """(a, b, kind, src, dst, verified): typed edges between different files."""
    own = with_files(nodes).select("id", "file")
    rows = edges.where(F.col("kind").isin(*kinds)).join(own.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return rows.where("a <> b").select("a", "b", "kind", "src", "dst", "verified")


def file_importance(nodes: DataFrame) -> DataFrame:
    """(file, importance, symbols) of files with symbols."""
    return with_files(nodes).where("kind = 'code-symbol'").groupBy("file").agg(F.round(F.max("importance"), 1).alias("importance"), F.count("*").alias("symbols"))


def blast(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """(file, dependent, kind, importance, rank): the files that lean on each file, one row each with the
    strongest tie and the importance of what ties there."""
    rows = file_edges(nodes, edges).join(nodes.select(F.col("id").alias("src"), "importance"), "src")
    tie = F.coalesce(*(F.when(F.col("kind") == kind, n) for kind, n in TIES.items()))
    per = rows.groupBy(F.col("b").alias("file"), F.col("a").alias("dependent"), "kind").agg(F.max("importance").alias("importance")).withColumn("tie", tie)
    best = per.groupBy("file", "dependent").agg(F.max(F.struct("tie", "importance", "kind")).alias("m")).select("file", "dependent", "m.*")
    return top_rows(best, ["file"], [F.desc("tie"), F.desc("importance"), "dependent"], k).select("file", "dependent", "kind", F.round("importance", 1).alias("importance"), "rank")


def dependencies(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """(file, target, kind, rank): what each file's symbols lean on, the strongest ties first."""
    tie = F.coalesce(*(F.when(F.col("kind") == kind, n) for kind, n in TIES.items()))
    rows = file_edges(nodes, edges).select(F.col("a").alias("file"), F.col("b").alias("target"), "kind").distinct()
    return top_rows(rows, ["file"], [F.desc(tie), "target"], k)


def superseded(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'supersedes'").select(F.col("dst").alias("id")).distinct()


def landmines(nodes: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """(file, node_id, kind, title, why, rank) for targets (file): what warns about the file, or about a
    symbol of its names, unless something newer stands in its place.

    A warning's object matches by its path, or by title or symbol, case aside: three equal joins and a
    union, never one join with an or. Which warnings come first does not depend on the file, so that each path
    and each name keeps its first ``k`` before files meet them: a name that many files and many objects share
    gives ``k`` rows a file, not all pairs.
    """
    asked = targets.select("file").distinct()
    here = with_files(nodes).join(asked, "file", "left_semi")
    name = F.explode(F.array(F.lower("symbol"), F.when(F.col("kind") == "code-symbol", F.lower("title")))).alias("name")
    names = here.select("file", name).where("name is not null and name <> ''").distinct()
    warns = edges.where("kind = 'warns_about'").select(F.col("src").alias("id"), "dst").distinct().join(superseded(edges), "id", "left_anti")
    objects = nodes.select(F.col("id").alias("dst"), normal(F.col("file")).alias("file"), F.lower("title").alias("t"), F.lower("symbol").alias("s"))
    object_ = warns.join(nodes.select("id", "importance"), "id").join(objects, "dst")
    order = [F.desc_nulls_last("importance"), F.desc("id")]
    first = lambda rows, by: top_rows(rows.distinct(), [by], order, k).drop("rank")
    by_path = first(object_.select("file", "id", "importance").join(asked, "file", "left_semi"), "file")
    called = object_.select(F.explode(F.array("t", "s")).alias("name"), "id", "importance").join(names.select("name").distinct(), "name", "left_semi")
    by_name = first(called, "name").join(names, "name").select("file", "id", "importance")
    rows = first(by_path.unionByName(by_name), "file").drop("importance").join(nodes.select("id", "kind", "title", text.first_line(F.coalesce("body", F.lit(""))).alias("why"), "importance"), "id")
    return top_rows(rows, ["file"], order, k).select("file", F.col("id").alias("node_id"), "kind", "title", "why", "rank")


def tasks_at(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, node_id, title): the open tasks that affect each file."""
    tasks = nodes.where((F.col("kind") == "task") & (notes.status(F.col("facets"), notes.ENDED_FIRST) == "open")).select(F.col("id").alias("src"), "title")
    return edges.where("kind = 'relates_to'").join(tasks, "src").join(with_files(nodes).select(F.col("id").alias("dst"), "file"), "dst").select("file", F.col("src").alias("node_id"), "title").distinct()


def open_tasks(nodes: DataFrame, edges: DataFrame, k: int = 4) -> DataFrame:
    """(file, node_id, title, rank): the oldest of :func:`tasks_at`."""
    return top_rows(tasks_at(nodes, edges), ["file"], ["node_id"], k)


def symbols(nodes: DataFrame, k: int = 30) -> DataFrame:
    """(file, node_id, symbol, line, rank): what each file defines, by line; not the file's own node."""
    rows = with_files(nodes).where("kind = 'code-symbol' and (symbol is not null or line is not null)").select("file", F.col("id").alias("node_id"), F.coalesce("symbol", "title").alias("symbol"), "line")
    return top_rows(rows, ["file"], [F.asc_nulls_first("line"), "node_id"], k)


def knowledge(nodes: DataFrame, anchors: DataFrame, targets: DataFrame, k: int = 6) -> DataFrame:
    """(file, node_id, kind, title, why, sha, predicate, outcome, rank) for targets (file): notes pinned to
    the file, and those that have its path as an anchor, the newest first."""
    asked = targets.select("file").distinct()
    pinned = with_files(nodes).join(asked, "file", "left_semi").select("file", "id")
    named = anchors.join(asked.select("file", F.lower("file").alias("term")), "term").select("file", F.col("node_id").alias("id"))
    rows = pinned.unionByName(named).distinct().join(nodes.where(~F.col("kind").isin(*NO_KNOWLEDGE)).select("id", "kind", "title", text.first_line(F.coalesce("body", F.lit(""))).alias("why"), F.left(F.col("sha").cast("string"), F.lit(7)).alias("sha"), "predicate", "outcome"), "id")
    return top_rows(rows, ["file"], [F.desc("id")], k).withColumnRenamed("id", "node_id")


def grouped(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(file, name): each file's rows as an array of structs, by rank."""
    own = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return rows.groupBy("file").agg(own.alias(name)).select("file", F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))


def around(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges at some files (file), written out: all that their symbols, open tasks, and what leans on them or
    they lean on are found by. Ranks within those files are the same as over the whole store."""
    here = with_files(nodes).join(files.select("file").distinct(), "file", "left_semi").select("id").distinct()
    ends = {end: here.select(F.col("id").alias(end), F.lit(True).alias(f"at_{end}")) for end in ("src", "dst")}
    near = graph.written(edges.join(ends["src"], "src", "left").join(ends["dst"], "dst", "left").where("at_src or at_dst").select(*edges.columns))
    ids = near.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(here).distinct()
    return graph.written(nodes.join(ids, "id", "left_semi")), near


def brief(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, drift: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target (file): known, symbols, why, warns, depends_on, breaks, open_tasks (arrays) and
    drift. A note that warns is not told again among the reasons. A file that nothing knows has empty arrays.
    The store is written out first, and what is at the targets, so that each part reads little."""
    asked = graph.written(targets.select("file").distinct())
    nodes, edges = graph.written(nodes), graph.written(edges)
    few, near = around(nodes, edges, asked)
    mine = lambda df: df.join(asked, "file", "left_semi")
    warns = graph.written(landmines(nodes, edges, asked))
    why = graph.written(knowledge(nodes, anchors, asked).join(drift.select(F.col("id").alias("node_id"), F.col("level").alias("drift")), "node_id", "left"))
    told = why.join(warns.select("file", "node_id"), ["file", "node_id"], "left_anti")
    known = mine(with_files(few)).select("file").unionByName(why.select("file")).distinct().withColumn("known", F.lit(True))
    parts = [
        grouped(mine(symbols(few)), "symbols", "node_id", "symbol", "line"), grouped(told, "why", "node_id", "kind", "title", "why", "sha", "drift", "predicate", "outcome"),
        grouped(warns, "warns", "node_id", "kind", "title", "why"), grouped(mine(dependencies(few, near)), "depends_on", "target", "kind"),
        grouped(mine(blast(few, near)), "breaks", "dependent", "kind", "importance"), grouped(mine(open_tasks(few, near)), "open_tasks", "node_id", "title"),
        freshness.worst_by_file(mine(with_files(drift))),
    ]
    out = asked.join(known, "file", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    for part in parts:
        out = out.join(part, "file", "left")
    return out.select(*(F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) if out.schema[c].dataType.typeName() == "array" else c for c in out.columns))


def annotated(files: DataFrame, nodes: DataFrame, edges: DataFrame, drift: DataFrame) -> DataFrame:
    """``files`` with importance, worst drift and whether something warns about them."""
    warned = landmines(nodes, edges, files, 1).select("file", F.lit(True).alias("landmine"))
    rows = files.join(file_importance(nodes).select("file", "importance"), "file", "left").join(freshness.worst_by_file(with_files(drift)), "file", "left").join(warned, "file", "left")
    return rows.withColumns({"importance": F.coalesce("importance", F.lit(0.0)), "landmine": F.coalesce("landmine", F.lit(False))})


def code_files(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(file) of source files with symbols that are there, without tests and entry points."""
    own = with_files(nodes).where("kind = 'code-symbol'").select("file").distinct().join(known.select("file").distinct(), "file", "left_semi")
    f = F.col("file")
    return own.where(paths.is_code(f) & ~paths.is_test(f) & ~paths.is_entry(f))


def dead(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(file) of source files that no structural edge leads to, from anywhere."""
    led = edges.where(F.col("kind").isin(*STRUCTURE)).join(with_files(nodes).select(F.col("id").alias("dst"), "file"), "dst").select("file").distinct()
    return code_files(nodes, known).join(led, "file", "left_anti")


def untested(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(file) of source files without an import between them and a test, either way."""
    between = file_edges(nodes, edges, ("depends_on", "calls"))
    tested = between.where(paths.is_test(F.col("a"))).select(F.col("b").alias("file")).unionByName(between.where(paths.is_test(F.col("b"))).select(F.col("a").alias("file"))).distinct()
    return code_files(nodes, known).join(tested, "file", "left_anti")


def is_adr(title, kind, facets):
    return F.col(title).ilike("ADR-%") | F.col(title).ilike("ADR %") | (F.col(kind) == "decision") | F.array_contains(facets, "foundation")


def stale_decisions(nodes: DataFrame, edges: DataFrame, touches: DataFrame, ranks: DataFrame, least: int = 2, k: int = 20) -> DataFrame:
    """(node_id, title, sha, files, score, stale_files): decisions whose files commits have changed since, of
    which one ``least`` times or more; files are those that the decision's edges lead to."""
    own = nodes.where(F.col("kind").isin("lesson", "decision") & (F.array_contains("facets", "foundation") | F.col("title").ilike("ADR-%") | F.col("title").ilike("ADR %")) & F.col("sha").isNotNull()).select("id", "title", "sha")
    code = with_files(nodes).where("kind = 'code-symbol'").select(F.col("id").alias("dst"), "file")
    refs = edges.select(F.col("src").alias("id"), "dst").join(own, "id").join(code, "dst").select("id", "title", "sha", "file").distinct()
    moved = refs.join(freshness.commits_since(refs, touches, ranks), ["file", "sha"]).where("commits_since > 0")
    per = moved.groupBy(F.col("id").alias("node_id"), "title", "sha").agg(F.count("*").alias("files"), F.sum("commits_since").alias("score"), F.max("commits_since").alias("most"), F.array_sort(F.collect_list(F.struct((-F.col("commits_since")).alias("n"), "file"))).alias("l"))
    stale = F.transform("l", lambda x: F.struct(x["file"].alias("file"), (-x["n"]).alias("commits_since"))).alias("stale_files")
    return per.where(F.col("most") >= least).orderBy(F.desc("score"), F.desc("files"), "node_id").limit(k).select("node_id", "title", "sha", "files", "score", stale)


def must_know(nodes: DataFrame, k: int = 8) -> DataFrame:
    """(node_id, title, slot): decisions that a newcomer must know. Of more than ``k`` the two of lowest number
    stay, and the newest; fewer are filled up with foundations by importance."""
    rows = nodes.where(F.col("kind").isin("lesson", "decision")).where(is_adr("title", "kind", "facets"))
    number = F.regexp_extract("title", r"^ADR[- ](\d+)", 1)
    rows = rows.select("id", "title", "importance", F.when(number != "", number.cast("int")).when(F.col("kind") == "decision", -1).alias("n"))
    # Each of the three short lists is a top-k of its own; what is ranked together is at most 3 k rows.
    newest = rows.where("n is not null").orderBy(F.desc("n"), F.desc("id")).limit(k + 1)
    founding = rows.where("n >= 0").orderBy("n", F.desc("id")).limit(2)
    fill = rows.where("n is null").orderBy(F.desc_nulls_last("importance"), F.desc("id")).limit(k)
    many = newest.agg((F.count("*") > k).alias("many"))
    first = founding.crossJoin(F.broadcast(many)).where("many").select("id", "title", F.lit("founding").alias("slot"), F.lit(0).alias("o"), F.col("n").alias("by"))
    rest = newest.join(first.select("id"), "id", "left_anti").select("id", "title", F.lit("newest").alias("slot"), F.lit(1).alias("o"), (-F.col("n")).alias("by"))
    more = fill.select("id", "title", F.lit("fill").alias("slot"), F.lit(2).alias("o"), (-F.coalesce("importance", F.lit(0.0))).cast("int").alias("by"))
    every = first.unionByName(rest).unionByName(more)
    return every.orderBy("o", "by", F.desc("id")).limit(k).select(F.col("id").alias("node_id"), "title", "slot")


def binding(nodes: DataFrame, edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(target, node_id, kind, title) for (target, file): of the notes that govern one of a target's files and
    that nothing supersedes, the most important."""
    rows = edges.where(F.col("kind").isin(*BINDING)).select(F.col("src").alias("id"), "dst").join(with_files(nodes).select(F.col("id").alias("dst"), "file"), "dst").join(scope, "file").select("target", "id").distinct()
    rows = rows.join(superseded(edges), "id", "left_anti").join(nodes.select("id", "kind", "title", "importance"), "id")
    return top_rows(rows, ["target"], [F.desc_nulls_last("importance"), F.desc("id")], 1).select("target", F.col("id").alias("node_id"), "kind", "title")


def neighborhood(nodes: DataFrame, edges: DataFrame, drift: DataFrame, targets: DataFrame, k: int = 8) -> DataFrame:
    """(target, file, confidence, co_degree, partner_degree, edge_verified, partner_drift, bound_by): the files
    that move with each target, how sure that is, how fresh, and the note that binds them."""
    nodes, edges = graph.written(nodes), graph.written(edges)
    every = graph.written(file_edges(nodes, edges, ("co_changed", "depends_on", "implements", "guarded_by")))
    both = every.where("kind = 'co_changed'")
    pairs = both.select(F.col("a").alias("target"), F.col("b").alias("file"), F.col("dst").alias("at"), "verified").unionByName(both.select(F.col("b").alias("target"), F.col("a").alias("file"), F.col("src").alias("at"), "verified"))
    degree = pairs.groupBy("target").agg(F.countDistinct("file").alias("partner_degree")).withColumnRenamed("target", "file")
    rows = pairs.join(targets.select(F.col("file").alias("target")).distinct(), "target", "left_semi").groupBy("target", "file").agg(F.countDistinct("at").alias("co_degree"), F.expr("bool_and(verified)").alias("edge_verified"))
    near = graph.written(top_rows(rows, ["target"], [F.desc("co_degree"), "file"], k))
    ties = every.where("kind <> 'co_changed'").select("a", "b")
    ties = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("target"), F.col("b").alias("file"), F.lit(True).alias("tied"))
    scope = near.select("target", "file").unionByName(targets.select(F.col("file").alias("target"), "file")).distinct()
    bound = binding(nodes, edges, scope).select("target", F.col("node_id").alias("bound_by"))
    out = near.join(degree, "file", "left").join(ties, ["target", "file"], "left").join(freshness.worst_by_file(with_files(drift)).withColumnRenamed("drift", "partner_drift"), "file", "left").join(bound, "target", "left")
    return out.select("target", "file", F.when(F.col("tied"), "import + co-change").otherwise("co-change only").alias("confidence"), "co_degree", "partner_degree", "edge_verified", "partner_drift", "bound_by")


def review(nodes: DataFrame, edges: DataFrame, files: DataFrame, dependents: int = 3, importance: float = 4.0) -> DataFrame:
    """(file, importance, dependents, open_tasks, reasons) of the changed files with a reason to look twice."""
    rows = files.select("file").distinct().join(file_importance(nodes).select("file", "importance"), "file", "left")
    rows = rows.join(blast(nodes, edges).groupBy("file").agg(F.count("*").alias("dependents")), "file", "left").join(open_tasks(nodes, edges).groupBy("file").agg(F.count("*").alias("open_tasks")), "file", "left").na.fill(0, ["dependents", "open_tasks"]).na.fill(0.0, ["importance"])
    reasons = F.array_compact(F.array(F.when(F.col("importance") >= importance, "load-bearing"), F.when(F.col("dependents") >= dependents, F.concat(F.col("dependents").cast("string"), F.lit(" dependents"))), F.when(F.col("open_tasks") > 0, "open task")))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def fate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, superseded_by, became_landmine) of decisions and lessons: what governs in their place now, at
    the end of the chain, and whether they warn of something."""
    head = graph.chain_head(edges.where("kind = 'supersedes'").select(F.col("dst").alias("old"), F.col("src").alias("new")).distinct())
    warns = edges.where("kind = 'warns_about'").select(F.col("src").alias("node_id")).distinct().withColumn("became_landmine", F.lit(True))
    own = nodes.where(F.col("kind").isin("decision", "lesson")).select(F.col("id").alias("node_id"))
    return own.join(head.select(F.col("node").alias("node_id"), F.col("head").alias("superseded_by")), "node_id", "left").join(warns, "node_id", "left").withColumn("became_landmine", F.coalesce("became_landmine", F.lit(False)))


def target_files(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, file): a known path is itself; else the files of the symbols of that name, case aside; else
    what looks like a path is taken as one."""
    t = F.regexp_replace(F.regexp_replace(F.trim(normal(F.col("target"))), r"^\./", ""), "/+$", "")
    asked = targets.select("target", t.alias("t")).where("t <> ''").distinct()
    own = with_files(nodes)
    known = asked.join(own.select(F.col("file").alias("t")).distinct(), "t", "left_semi").select("target", F.col("t").alias("file"))
    rest = asked.join(known.select("target"), "target", "left_anti").withColumn("low", F.lower("t"))
    code = own.where("kind = 'code-symbol'")
    names = code.select(F.lower("symbol").alias("low"), "file").unionByName(code.select(F.lower("title").alias("low"), "file")).where("low is not null").distinct()
    named = rest.join(names, "low").select("target", "file").distinct()
    guessed = rest.join(named.select("target").distinct(), "target", "left_anti").where(F.col("t").contains("/")).select("target", F.col("t").alias("file"))
    return known.unionByName(named).unionByName(guessed)


def touches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, breaks, depends, symbols, open_tasks) of every file: the edges that lead to it from other files, those that lead
    from it to others, what it defines by name or line, and the open tasks that affect it, all of them."""
    ties = file_edges(nodes, edges)
    out = with_files(nodes).select("file").distinct()
    for name, rows in (
        ("breaks", ties.select(F.col("b").alias("file"))), ("depends", ties.select(F.col("a").alias("file"))),
        ("symbols", with_files(nodes).where("kind = 'code-symbol' and (symbol is not null or line is not null)")), ("open_tasks", tasks_at(nodes, edges)),
    ):
        out = out.join(rows.groupBy("file").agg(F.count("*").alias(name)), "file", "left")
    return out.na.fill(0)


def file_graph(nodes: DataFrame, edges: DataFrame, drift: DataFrame, cap: int = 140) -> tuple[DataFrame, DataFrame]:
    """The files to show (file, importance, freshness, guarded, lessons, tasks, degree), the most important
    and best tied ones, and the edges (a, b, family) among them."""
    cap = max(10, min(400, cap))
    public = with_files(nodes).where(~notes.is_noise(F.col("file")))
    ties = file_edges(public, edges, tuple(notes.FAMILIES)).select("a", "b", notes.mapped(notes.FAMILIES, F.col("kind"), "relates").alias("family")).distinct()
    ties = graph.written(ties)  # degrees, guards and what is shown read them
    degree = ties.select(F.explode(F.array("a", "b")).alias("file")).groupBy("file").agg(F.count("*").alias("degree"))
    guarded = ties.where("family = 'guards'").select(F.col("b").alias("file"), F.lit(True).alias("guarded")).distinct()
    counts = public.where(F.col("kind").isin("lesson", "task")).groupBy("file").pivot("kind", ["lesson", "task"]).count().withColumnsRenamed({"lesson": "lessons", "task": "tasks"})
    fresh = freshness.worst_by_file(with_files(drift)).select("file", notes.mapped(notes.SHOWN, F.col("drift"), "fresh").alias("freshness"))
    rows = file_importance(public).select("file", "importance").join(degree, "file", "left").join(guarded, "file", "left").join(counts, "file", "left").join(fresh, "file", "left").na.fill(0, ["degree", "lessons", "tasks"]).na.fill("fresh", ["freshness"]).na.fill(False, ["guarded"])
    chosen = rows.orderBy(F.desc(F.col("importance") + 8 * F.col("degree")), "file").limit(cap)
    names = chosen.select("file")
    shown = ties.join(names.select(F.col("file").alias("a")), "a", "left_semi").join(names.select(F.col("file").alias("b")), "b", "left_semi")
    return chosen, shown.select("a", "b", "family")
