"""Notes and tasks in markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import notes, text
from . import tree

LEAST_PROSE, LEAST_LENGTH, LEAST_ANCHORS = 100, 60, 3


def _title(section):
    return F.trim(F.regexp_replace(F.substring_index(section, "\n", 1), r"^[# ]+", ""))


def sections(files: DataFrame) -> DataFrame:
    """(path, at, title, body, anchors, facets): the lessons of knowledge files (path, text).

    A file is cut before headings of level two and three. A section with enough prose of its own is a lesson.
    A heading of level two with less is hollow: the short sections of level three under it join it and are
    one lesson together, if that is enough; a long one under it is a lesson with both titles. What comes
    before the first such heading is none, unless it is the whole file.
    """
    cut = F.transform(F.split("text", r"\n(?=#{2,3}\s)"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    each = files.select("path", F.size(cut).alias("n"), F.posexplode(cut).alias("at", "s"))
    big = (F.length("s") >= LEAST_LENGTH) & (notes.own_prose(F.col("s")) >= LEAST_PROSE)
    rows = each.withColumn("big", big).withColumn("two", F.col("s").startswith("## ")).withColumn("one", F.col("s").startswith("# ") & (F.col("n") > 1))
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A bucket opens at a hollow heading of level two, and any other such heading or a preamble ends it.
    rows = rows.withColumn("group", F.sum((F.col("two") | F.col("one")).cast("int")).over(w))
    head = rows.where("two and not big").select("path", "group", F.col("s").alias("head"))
    rows = rows.where("not one").join(head, ["path", "group"], "left")
    alone = rows.where("big").select("path", "at", F.when(F.col("head").isNotNull() & ~F.col("two"), F.concat(_title(F.col("head")), F.lit(" — "), _title(F.col("s")))).otherwise(_title(F.col("s"))).alias("title"), F.col("s").alias("body"))
    short = rows.where("not big and head is not null").groupBy("path", "group").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("l")).where(F.size("l") > 1)
    joined = short.select("path", F.col("l")[0]["at"].alias("at"), _title(F.col("l")[0]["s"]).alias("title"), F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("body")).where(notes.own_prose(F.col("body")) >= LEAST_PROSE)
    found = alone.unionByName(joined).withColumn("anchors", text.anchors(F.left("body", F.lit(2000)))).where(F.size("anchors") >= LEAST_ANCHORS)
    return found.select("path", "at", F.left("title", F.lit(120)).alias("title"), F.left("body", F.lit(600)).alias("body"), "anchors", notes.knowledge_facets(F.col("path")).alias("facets"))


def tasks(files: DataFrame) -> DataFrame:
    """(path, title, status, kind, affects, tags, body): tasks in markdown files (path, text). Unknown states are
    open, unknown kinds tasks; without a title the first line that has words is one; without any, none."""
    own = tree.frontmatter(files)
    meta = lambda key: F.lower(F.try_element_at("meta", F.lit(key)))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[# ]+", ""))), lambda x: x != "")
    title = F.coalesce(F.nullif(F.trim(F.try_element_at("meta", F.lit("title"))), F.lit("")), F.get(lines, 0))
    listed = lambda key: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit("")), r"[\[\]'\"]", ""), r"[,\s]+"), F.trim), lambda x: x != "")
    kind = F.when(meta("kind").isin("task", "plan", "feature", "roadmap", "sprint"), meta("kind")).otherwise("task")
    rows = own.select("path", F.left(title, F.lit(120)).alias("title"), F.when(meta("status").isin(*notes.STATUSES), meta("status")).otherwise("open").alias("status"), kind.alias("kind"), F.transform(listed("affects"), lambda x: F.translate(x, "\\", "/")).alias("affects"), F.array_union(listed("tags"), F.array(kind)).alias("tags"), "body")
    return rows.where("title is not null")


def steps(found: DataFrame) -> DataFrame:
    """(path, total, done, moved, dropped, resolved): the checklists of tasks (path, body)."""
    per = tree.checklist(found.select("path", "body")).groupBy("path").agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("done", "moved", "dropped")))
    return per.withColumn("resolved", F.col("done") + F.col("moved") + F.col("dropped"))


def flip_candidates(found: DataFrame) -> DataFrame:
    """(path, title, steps): open tasks whose steps are all resolved."""
    return found.where("status = 'open'").join(steps(found), "path").where("total > 0 and resolved = total").select("path", "title", F.col("total").alias("steps"))
