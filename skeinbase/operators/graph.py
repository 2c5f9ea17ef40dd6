"""Graph operators over edges (src, dst, kind)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRUCTURAL = ("depends_on", "implements", "guarded_by", "decided_by")
DAMPING = 0.85
#: Ranks, of a sum of one, that change by less in all stand still.
STILL = 2e-15
#: Rows that a task of :func:`walk` makes or reads, more or less.
WALKED = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; on a single machine without one, its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skeinbase-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the checkpoint folder and read from there.

    For loops with joins: a checkpoint keeps the optimizer's guess of its size, which is the product of what was
    joined and so gets longer in each round, until planning takes longer than the work; a table has its own.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def adjacency(edges: DataFrame, kinds=STRUCTURAL) -> DataFrame:
    """Distinct (src, dst) of the kinds given, without self loops."""
    return edges.where(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def reached(targets: DataFrame, pairs: DataFrame, depth: int = 2, forward: bool = False) -> DataFrame:
    """(target, node, hop): what each target reaches along ``pairs`` (src, dst), backwards unless
    ``forward``, at its least distance of 1 to ``depth``. All targets go at once; the depth is small,
    so the rounds unroll into one plan."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    step = pairs.select(F.col(near).alias("node"), F.col(far).alias("next"))
    seen = targets.select("target", F.col("target").alias("node"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.join(step, "node").select("target", F.col("next").alias("node")).distinct()
        frontier = new.join(seen.select("target", "node"), ["target", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def walk(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, hop, kind, node): the typed edges that up to ``hops`` steps from a seed go along; rows
    of one hop are distinct, coming back is allowed.

    The rows that a step makes are counted first, by the edges out of each node, and dealt over as many tasks as they
    need (WALKED): a task's memory does not grow with the input.
    """
    spark = edges.sparkSession
    edges = written(edges.select("src", "kind", "dst"))  # each step reads them
    ways = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ways"))
    at = written(seeds.select("seed", F.col("seed").alias("node")))
    all_edges, out = edges.count(), None
    for hop in range(1, hops + 1):
        made = at.join(ways, "node").agg(F.sum("ways")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-(made + all_edges) // WALKED))
        met = at.repartition(tasks, "node").join(edges.withColumnRenamed("src", "node").repartition(tasks, "node"), "node")
        step = met.select("seed", "kind", F.col("dst").alias("node")).repartition(tasks, "seed", "node").distinct()
        if hop < hops:
            step = written(step)
            at = step.select("seed", "node").distinct()
        rows = step.withColumn("hop", F.lit(hop))
        out = rows if out is None else out.unionByName(rows)
    return out.select("seed", "hop", "kind", "node")


def chain_head(pairs: DataFrame, depth: int = 16) -> DataFrame:
    """(node, head, steps): the newest along ``pairs`` (new, old) from each old node: the deepest within
    ``depth`` steps, then the greatest id. Cycles are walked until the depth ends."""
    pairs = written(pairs.select("old", "new").distinct())  # each step reads them
    out = at = pairs.select(F.col("old").alias("node"), F.col("new").alias("head"), F.lit(1).alias("steps"))
    for steps in range(2, depth + 1):
        at = written(at.join(pairs.select(F.col("old").alias("head"), "new"), "head").select("node", F.col("new").alias("head"), F.lit(steps).alias("steps")).distinct())
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.groupBy("node").agg(F.max_by("head", F.struct("steps", "head")).alias("head"), F.max("steps").alias("steps"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, rank) over (src, dst), parallel edges counted; the rank of nodes without a way out is
    dealt to all. Ranks add up to one, so that what those nodes hold is what the others have not dealt.

    What each round deals is written out: it is both joined and added up. The edges stay dealt by ``src``. A round
    changes all ranks together by DAMPING of what the last one changed at most, so that what is left of the rounds adds
    up to less than 6 times the last change: where that is beyond what doubles hold (STILL), they change nothing.
    """
    weight = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = weight.groupBy("src").agg(F.sum("w").alias("total"))
    own = cut(nodes.select("node"))
    n = max(1, own.count())
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = cut(weight.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")).repartition(parts, "src"))
    rank = own.select("node", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        got = written(rank.join(step, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got")))
        lost = got.agg((1 - F.coalesce(F.sum("got"), F.lit(0.0))).alias("lost"))
        every = (1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        last, rank = rank, written(own.join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost)).select("node", every.alias("rank")))  # one row of lost rank
        change = rank.join(last.withColumnRenamed("rank", "before"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        if change is None or change < STILL:
            break
    return rank


def scaled(ranks: DataFrame) -> DataFrame:
    """(node, importance): ranks spread over 1 to 100; 1 if all are equal."""
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    spread = F.when(F.col("hi") > F.col("lo"), F.round(1 + 99 * (F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")), 1)).otherwise(1.0)
    return ranks.crossJoin(F.broadcast(ends)).select("node", spread.alias("importance"))  # one row of ends


def cycles(pairs: DataFrame, longest: int = 3) -> DataFrame:
    """(files, length): elementary cycles of up to ``longest`` nodes, each once, from its least node."""
    step = pairs.select(F.col("src").alias("end"), F.col("dst").alias("next"))
    paths = pairs.where("src < dst").select(F.array("src", "dst").alias("files"), F.col("src").alias("start"), F.col("dst").alias("end"))
    out = None
    for length in range(2, longest + 1):
        closed = paths.join(step.select("end", F.col("next").alias("start")), ["start", "end"], "left_semi")
        found = closed.select("files", F.lit(length).alias("length"))
        out = found if out is None else out.unionByName(found)
        if length < longest:
            more = paths.join(step, "end").where((F.col("next") > F.col("start")) & ~F.array_contains("files", F.col("next")))
            paths = more.select(F.concat("files", F.array("next")).alias("files"), "start", F.col("next").alias("end"))
    return out


def cochange(commit_files: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """(a, b, commits): files changed together, both ways; commits of fewer than ``least`` or more than
    ``most`` files tell nothing, so that no commit makes many pairs."""
    sized = commit_files.where("sha is not null").select("sha", "file", F.count("*").over(Window.partitionBy("sha")).alias("n"))
    held = sized.where(F.col("n").between(least, most)).groupBy("sha").agg(F.collect_list("file").alias("files"))  # ``most`` of them at most
    pairs = held.select(F.explode("files").alias("a"), "files").select("a", F.explode("files").alias("b")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("commits"))


def co_degree(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("file")).agg(F.countDistinct("b").alias("degree"))


def top_per(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
