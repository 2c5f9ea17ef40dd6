"""Changes of the store: each takes tables and gives the new ones; doing it again changes nothing.

Nodes (id, kind, title, file, line, origin, run, importance, ...), edges (src, dst, kind, verified, run),
anchors (node_id, term), feedback (node_id, useful, missed), log (ts, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.paths import normal


def without_nodes(gone: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the nodes of ``gone`` (id), nor edges and anchors at them."""
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), edges.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")]), anchors.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def of_origin(nodes: DataFrame, origin: str) -> DataFrame:
    return nodes.where(F.col("origin") == origin).select("id")


def symbols_of_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols that were read from ``files`` (file): what a change of these files replaces; notes stay."""
    own = nodes.where("kind = 'code-symbol' and origin = 'bootstrap'").withColumn("file", normal(F.col("file")))
    return own.join(files.select(normal(F.col("file")).alias("file")).distinct(), "file", "left_semi").select("id")


def tasks_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All tasks, and the stand-ins for files that only tasks had edges to."""
    tasks = nodes.where("kind = 'task'").select("id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(tasks.select(F.col("id").alias(end)), end, "left_anti")
    used = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    stand_ins = nodes.where("kind = 'file' and origin = 'task-anchor'").join(used, "id", "left_anti").select("id")
    return tasks.unionByName(stand_ins).distinct()


def forgettable(nodes: DataFrame, asked: DataFrame, force: bool = False) -> DataFrame:
    """(id, refused) of the nodes asked for (id): what was read from the repository is refused, unless forced."""
    return nodes.join(asked.select("id").distinct(), "id", "left_semi").select("id", ((F.col("origin") == "bootstrap") & F.lit(not force)).alias("refused"))


def add_anchors(anchors: DataFrame, incoming: DataFrame) -> DataFrame:
    """The (node_id, term) that are new: trimmed, in lower case, none empty. With ``anchors`` they are the
    new table, and alone the ledger of what a run must take back."""
    new = incoming.select("node_id", F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    return new.join(anchors, ["node_id", "term"], "left_anti")


def take_back_anchors(anchors: DataFrame, ledger: DataFrame) -> DataFrame:
    return anchors.join(ledger.select("node_id", F.lower(F.trim("term")).alias("term")), ["node_id", "term"], "left_anti")


def new_id(*parts: Column | str) -> Column:
    """A negative id that depends on what it names: the same whenever it is made."""
    return -F.abs(F.xxhash64(*parts) % (2**62)) - 1


def edges_to_targets(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, kind) for ``wanted`` (src, kind, target), and the nodes (id, title) that have to be
    made for them: a target is the symbol of that title, the one of least id, or a new one."""
    wanted = wanted.select("src", "kind", F.trim("target").alias("target")).where("target <> ''").distinct()
    known = nodes.where("kind = 'code-symbol'").groupBy(F.col("title").alias("target")).agg(F.min("id").alias("known"))
    rows = wanted.join(known, "target", "left").withColumn("dst", F.coalesce("known", new_id("target")))
    return rows.select("src", "dst", "kind"), rows.where("known is null").select(F.col("dst").alias("id"), F.col("target").alias("title")).distinct()


def representatives(nodes: DataFrame) -> DataFrame:
    """(file, id): the first symbol of each file by line; a node without a line is the file itself and comes first."""
    own = nodes.where("kind = 'code-symbol' and file is not null and file <> ''").select(normal(F.col("file")).alias("file"), "id", "line")
    return own.groupBy("file").agg(F.min_by("id", F.struct(F.coalesce("line", F.lit(-1)), "id")).alias("id"))


def file_edges(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, kind: str = "depends_on") -> DataFrame:
    """New edges (src, dst, kind) for the file pairs (from, to), between the files' first symbols; files
    without one, self edges and edges that are there give none."""
    rep = representatives(nodes)
    rows = pairs.join(rep.select(F.col("file").alias("from"), F.col("id").alias("src")), "from").join(rep.select(F.col("file").alias("to"), F.col("id").alias("dst")), "to")
    return rows.where("src <> dst").select("src", "dst", F.lit(kind).alias("kind")).distinct().join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")


def task_links(nodes: DataFrame, edges: DataFrame, affects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relates_to edges for ``affects`` (task, file), and the stand-ins (id, file) that have to be made: a
    file's first symbol, else any of its nodes (one that is no stand-in, of least id), else a new one."""
    own = nodes.where("file is not null and file <> ''").withColumn("file", normal(F.col("file")))
    any_node = own.groupBy("file").agg(F.min_by("id", F.struct((F.col("kind") == "file").cast("int"), "id")).alias("any"))
    wanted = affects.select("task", normal(F.col("file")).alias("file")).where("file <> ''").distinct()
    rows = wanted.join(representatives(nodes).withColumnRenamed("id", "symbol"), "file", "left").join(any_node, "file", "left").withColumn("dst", F.coalesce("symbol", "any", new_id(F.lit("file"), "file")))
    made = rows.where("symbol is null and any is null").select(F.col("dst").alias("id"), "file").distinct()
    links = rows.where("task <> dst").select(F.col("task").alias("src"), "dst", F.lit("relates_to").alias("kind")).distinct()
    return links.join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti"), made


def add_feedback(feedback: DataFrame, votes: DataFrame) -> DataFrame:
    """(node_id, useful, missed) with those of ``votes`` added."""
    return feedback.select("node_id", "useful", "missed").unionByName(votes.select("node_id", "useful", "missed")).groupBy("node_id").agg(F.sum("useful").alias("useful"), F.sum("missed").alias("missed"))


def persist_importance(nodes: DataFrame, ranked: DataFrame, feedback: DataFrame) -> DataFrame:
    """``nodes`` with the importance of ``ranked`` (node, importance), moved by feedback; others keep theirs."""
    net = feedback.groupBy("node_id").agg(F.sum("useful").alias("__u"), F.sum("missed").alias("__m")).withColumnRenamed("node_id", "id")
    rows = nodes.join(ranked.select(F.col("node").alias("id"), F.col("importance").alias("__r")), "id", "left").join(net, "id", "left")
    moved = F.round(scores.feedback(F.col("__r"), F.coalesce("__u", F.lit(0)), F.coalesce("__m", F.lit(0))), 1)
    return rows.withColumn("importance", F.when(F.col("__r").isNotNull(), moved).otherwise(F.col("importance"))).select(*nodes.columns)


def refine(edges: DataFrame, labels: DataFrame, allowed: tuple[str, ...], run: int) -> DataFrame:
    """``edges`` (src, dst, kind, refined_from, run) with the kinds of ``labels`` (src, dst, kind) on depends_on
    edges, the old kind kept; kinds that aren't allowed change nothing."""
    new = labels.where(F.col("kind").isin(*allowed)).groupBy("src", "dst").agg(F.min("kind").alias("__new"))
    rows = edges.join(new, ["src", "dst"], "left").withColumn("__hit", F.col("__new").isNotNull() & (F.col("kind") == "depends_on") & (F.col("__new") != F.col("kind")))
    return rows.select(*(
        F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("kind")).alias(c) if c == "kind" else
        F.when(F.col("__hit"), F.col("kind")).otherwise(F.col("refined_from")).alias(c) if c == "refined_from" else
        F.when(F.col("__hit"), F.lit(run)).otherwise(F.col("run")).alias(c) if c == "run" else F.col(c) for c in edges.columns
    ))


def unrefine(edges: DataFrame, run: int | None = None) -> DataFrame:
    """The kinds that edges had before :func:`refine`, of one run or of all."""
    hit = F.col("refined_from").isNotNull() & (F.lit(run is None) | F.col("run").eqNullSafe(F.lit(run)))
    return edges.withColumns({"kind": F.when(hit, F.col("refined_from")).otherwise(F.col("kind")), "run": F.when(hit, None).otherwise(F.col("run")), "refined_from": F.when(~hit, F.col("refined_from"))})


def diff_files(diff: DataFrame, order: str = "at") -> DataFrame:
    """(file, deleted) of rows (at, token) of a NUL-separated name-status listing: A, M and D take one path, R
    and C an old and a new one. The tokens are read as states of one pass."""
    tokens = diff.where("token <> ''")
    size = F.when(F.col("token").rlike("^[RC][0-9]*$"), 3).otherwise(2)
    listed = tokens.groupBy().agg(F.sort_array(F.collect_list(F.struct(order, "token"))).alias("t"))  # one listing, of one commit range
    start = F.struct(F.lit(0).alias("skip"), F.lit("").alias("status"), F.expr("cast(array() as array<struct<file:string,deleted:boolean>>)").alias("out"))

    def step(acc, x):
        status = x["token"]
        opens = acc["skip"] == 0
        renames = acc["status"].rlike("^R")
        gone = acc["status"].rlike("^D") | (renames & (acc["skip"] == 2))
        row = F.struct(normal(status).alias("file"), gone.alias("deleted"))
        copied = acc["status"].rlike("^C") & (acc["skip"] == 2)
        return F.struct(
            F.when(opens, F.when(status.rlike("^[RC][0-9]*$"), 2).otherwise(1)).otherwise(acc["skip"] - 1).alias("skip"),
            F.when(opens, status).otherwise(acc["status"]).alias("status"),
            F.when(opens | copied, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"),
        )

    del size
    return listed.select(F.inline(F.aggregate("t", start, step)["out"]))


def update_files(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, changed: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after a change of the files ``changed`` (file, deleted): their old symbols go, with edges and
    anchors, and the symbols ``fresh`` (columns of ``nodes``) of files that are still there come in."""
    kept, left, terms = without_nodes(symbols_of_files(nodes, changed), nodes, edges, anchors)
    alive = changed.groupBy(normal(F.col("file")).alias("file")).agg(F.expr("bool_and(deleted)").alias("gone")).where("not gone")
    new = fresh.join(alive.select("file"), normal(fresh["file"]) == alive["file"], "left_semi")
    return kept.unionByName(new.select(*kept.columns)), left, terms


def needs_rebuild(meta: DataFrame, version: int) -> DataFrame:
    """(rebuild): whether the store was made by rules older than ``version``, or of no version."""
    return meta.where("key = 'rules_version'").agg((F.coalesce(F.max(F.col("value").cast("int")), F.lit(0)) < version).alias("rebuild"))


def logged(log: DataFrame, event: DataFrame) -> DataFrame:
    """``log`` with more events; columns that they lack are null."""
    return log.unionByName(event, allowMissingColumns=True)


def sized(log: DataFrame, answers: DataFrame) -> DataFrame:
    """``log`` with the sizes (id, chars) of answers given since, on rows that have none."""
    return log.join(answers.select("id", F.col("chars").alias("__c")), "id", "left").withColumn("chars", F.coalesce("chars", "__c")).select(*log.columns)


def rank_runs(meta: DataFrame) -> DataFrame:
    """(run, status, scope) of the ledger's rows (key 'run:<n>', value JSON), the newest first by number."""
    info = F.from_json("value", "status string, scope string")
    rows = meta.where(F.col("key").startswith("run:")).select(F.substring_index("key", ":", -1).cast("long").alias("run"), info["status"].alias("status"), info["scope"].alias("scope"))
    return rows.withColumn("newest", F.row_number().over(Window.orderBy(F.desc("run"))))  # one row for each run of a model
