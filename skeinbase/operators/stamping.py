"""A batch of notes stamped as if they had come one by one.

What becomes of a note depends on the notes before it: it goes into the node that it restates, if there is one by
then, and its anchors with it. All notes are decided at once from a guess of where the others went, and again
until no decision changes. A decision rests on earlier notes only, so that after each round at least one more of
every chain is final, and what stands still is what one-by-one stamping gives. Chains are short, notes are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims, text
from .graph import written

#: The share of a note's anchors that one node must have, and the similarity of words that makes two titles one.
GATE = 0.45
REWORDED = 0.6
#: In place of a time: before all notes of the batch.
BEFORE = -1

_NONE = "cast(array() as array<string>)"


def title_words(title: Column) -> Column:
    """Distinct words of three letters, digits or underscores and more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 2))


def prepared(incoming: DataFrame) -> DataFrame:
    """``incoming`` as it is stamped, with ``rejected``: why a note is not, or null.

    Long titles without a body are cut behind a sentence, the rest becoming the body; anchors are trimmed, in lower
    case, distinct and not empty; empty predicates and outcomes are none. A note without a title, with a
    predicate that is no claim, or with a file outside of the tree is rejected.
    """
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    cut = text.split_headline(F.col("title"))
    whole = F.when(blank, cut["headline"]).otherwise(F.trim("title"))
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    path = F.translate("file", "\\", "/")
    out = path.rlike(r"^/|^[A-Za-z]:") | F.coalesce(F.array_min(_depths(path)) < 0, F.lit(False))
    anchors = F.array_distinct(F.filter(F.transform(F.coalesce("anchors", F.expr(_NONE)), lambda a: F.lower(F.trim(a))), lambda a: a != ""))
    rows = incoming.select("seq", whole.alias("title"), F.when(blank, F.nullif(cut["rest"], F.lit(""))).otherwise(F.col("body")).alias("body"), F.array_sort(anchors).alias("anchors"), F.coalesce("facets", F.expr(_NONE)).alias("facets"), F.coalesce("private", F.lit(False)).alias("private"), said("predicate").alias("predicate"), said("outcome").alias("outcome"), path.alias("file"), out.alias("out"))
    why = F.when(F.coalesce("title", F.lit("")) == "", "no title").when(F.col("predicate").isNotNull() & ((F.length("predicate") > 500) | claims.parse(F.col("predicate")).isNull()), "unusable predicate").when(F.col("out"), "file outside of the tree")
    return rows.withColumn("rejected", why).drop("out")


def _depths(path: Column) -> Column:
    """How deep each step of a path leads; below zero is outside."""
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), lambda x: F.when(x == "..", -1).otherwise(1))
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.aggregate(F.slice(steps, F.lit(1), n), F.lit(0), lambda a, x: a + x))


def similar_titles(titles: DataFrame) -> DataFrame:
    """(title, other, similarity) of different titles (title) whose words overlap by REWORDED, both ways.

    They meet under the rarest words of each, as many as similar titles must share one of; titles of the same words are one
    there, so that however many there are they do not meet one another word by word."""
    words = titles.select("title", F.array_sort(title_words(F.col("title"))).alias("words")).where(F.size("words") > 0)
    bags = words.select("words").distinct().withColumn("bag", F.xxhash64("words"))
    each = bags.select("bag", F.size("words").alias("n"), F.explode("words").alias("word"))
    rare = each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word").withColumn("at", F.row_number().over(Window.partitionBy("bag").orderBy("df", "word")))
    keys = written(rare.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * REWORDED) + 1).select("bag", "word", "n"))
    near = (F.col("x.n") * REWORDED <= F.col("y.n")) & (F.col("y.n") * REWORDED <= F.col("x.n"))
    met = keys.alias("x").join(keys.alias("y"), "word").where(near).select(F.col("x.bag").alias("a"), F.col("y.bag").alias("b")).distinct()
    both = met.join(bags.select(F.col("bag").alias("a"), F.col("words").alias("wa")), "a").join(bags.select(F.col("bag").alias("b"), F.col("words").alias("wb")), "b")
    pairs = both.withColumn("similarity", text.jaccard(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= REWORDED)
    named = words.select("title", "words")
    found = pairs.join(named.select(F.col("words").alias("wa"), "title"), "wa").join(named.select(F.col("words").alias("wb"), F.col("title").alias("other")), "wb")
    return found.where("title <> other").select("title", "other", "similarity")


def decided(nodes: DataFrame, notes: DataFrame, max_rounds: int = 1000) -> tuple[DataFrame, int]:
    """((seq, node, new), rounds): the node that each note (seq, title, anchors) goes into, ``new`` where it is its own.

    ``nodes`` are (node_id, title, anchors). A new node's number is the greatest node id plus one plus ``seq``. A note goes into
    the node of least number that has its title, case and white space aside, and an anchor of it; without one into that
    whose title is the most alike, by REWORDED at least, and has an anchor of it; if by then some node has GATE of its
    anchors. Notes without anchors are always new.
    """
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).cast("long")).first()[0] + 1
    keyed = notes.select("seq", text.title_key(F.col("title")).alias("key"), "anchors", (F.col("seq") + top).alias("own"))
    own = written(keyed.select("*", F.size("anchors").alias("n")))
    old = nodes.select(F.col("node_id").alias("node"), text.title_key(F.col("title")).alias("key"), F.explode("anchors").alias("anchor"))
    old = written(old.select("node", "key", "anchor", F.lit(BEFORE).cast("long").alias("since")).distinct())
    asked = written(own.select("seq", "key", "n", F.explode("anchors").alias("anchor")))
    alike = written(similar_titles(own.select(F.col("key").alias("title")).union(old.select("key")).distinct()))
    df = old.select("anchor").unionByName(asked.select("anchor")).groupBy("anchor").agg(F.count("*").alias("df"))
    ranked = asked.join(df, "anchor").withColumn("at", F.row_number().over(Window.partitionBy("seq").orderBy("df", "anchor")))
    # A node with GATE of a note's anchors has one of these rarest ones.
    rare = written(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * GATE) + 1).select("seq", "n", "anchor"))
    guess = own.select("seq", F.col("own").alias("node"))
    keys = own.select(F.col("own").alias("node"), F.col("key"))
    titles = old.select("node", "key").distinct().unionByName(keys)
    for done in range(1, max_rounds + 1):
        into = guess.join(titles, "node").join(asked.select("seq", "anchor"), "seq").select("node", "key", "anchor", F.col("seq").alias("since"))
        held = written(old.unionByName(into).groupBy("node", "key", "anchor").agg(F.min("since").alias("since")))
        # The least node so far under a title and an anchor: notes and holders in the order of their coming.
        seen = held.select("key", "anchor", "since", "node", F.lit(None).cast("long").alias("seq")).unionByName(asked.select("key", "anchor", F.col("seq").alias("since"), F.lit(None).cast("long").alias("node"), "seq"))
        before = Window.partitionBy("key", "anchor").orderBy("since").rangeBetween(Window.unboundedPreceding, -1)
        same = seen.withColumn("least", F.min("node").over(before)).where("seq is not null and least is not null").groupBy("seq").agg(F.min("least").alias("same"))
        met = asked.join(alike, asked["key"] == alike["title"]).select("seq", "anchor", "other", "similarity")
        like = met.join(held.select(F.col("key").alias("other"), "anchor", "node", "since"), ["other", "anchor"]).where("since < seq").groupBy("seq").agg(F.max_by("node", F.struct("similarity", -F.col("node"))).alias("like"))
        named = written(own.select("seq", "own", "n").join(same, "seq", "left").join(like, "seq", "left").select("seq", "own", "n", F.coalesce("same", "like").alias("into")).where("into is not null"))
        mine = asked.join(named.select("seq", F.col("into").alias("node")), "seq").join(held.select("node", "anchor", "since"), ["node", "anchor"]).where("since < seq").groupBy("seq").agg(F.count("*").alias("shared"))
        near = written(named.join(mine, "seq").select("seq", "n", "shared", (F.col("shared") >= F.col("n") * GATE).alias("open")))
        # Others open the gate where some node, of whatever title, has enough.
        some = rare.join(near.where("not open").select("seq"), "seq", "left_semi").join(held.select("anchor", "node", "since"), "anchor").where("since < seq").select("seq", "node", "n").distinct()
        counts = some.join(asked.select("seq", "anchor"), "seq").join(held.select("node", "anchor", "since"), ["node", "anchor"]).where("since < seq").groupBy("seq", "node", "n").agg(F.count("*").alias("shared"))
        opened = near.where("open").select("seq").unionByName(counts.where(F.col("shared") >= F.col("n") * GATE).select("seq")).distinct()
        chosen = named.join(opened, "seq").select("seq", F.col("into").alias("to"))
        now = written(own.select("seq", "own").join(chosen, "seq", "left").select("seq", F.coalesce("to", "own").alias("node"), F.col("to").isNull().alias("new")))
        moved = now.join(guess.select("seq", F.col("node").alias("was")), "seq").where("node <> was").isEmpty()
        guess = now.select("seq", "node")
        if moved:
            return now, done
    raise RuntimeError(f"decisions still change after {max_rounds} rounds")


def stamp_batch(nodes: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, told): the store after a batch of notes, the same as after one by one in the order of ``seq``; and what became of
    each: (seq, action, node_id, added, rejected), with the anchors that a merge has added.

    ``nodes`` are (node_id, title, body, anchors, facets, private, predicate, outcome, file), ids distinct; ``incoming`` has a
    distinct ``seq`` of 0 or more in place of the id. See :func:`prepared` and :func:`decided`. A node keeps its title, body and file; anchors
    and facets are added in the order of their coming; the last predicate and outcome that were given count, none is cleared;
    what was private once stays so. Rejected notes change nothing.
    """
    ready = written(prepared(incoming))
    notes = ready.where("rejected is null")
    where, _ = decided(nodes.select("node_id", "title", F.coalesce("anchors", F.expr(_NONE)).alias("anchors")), notes.select("seq", "title", "anchors"))
    placed = written(notes.join(where, "seq"))
    fields = ["title", "body", "anchors", "facets", "private", "predicate", "outcome", "file"]
    first = nodes.select(F.col("node_id").alias("node"), F.lit(BEFORE).cast("long").alias("seq"), *fields).unionByName(placed.select("node", "seq", *fields))
    come = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("anchors", F.expr(_NONE)).alias("anchors"), F.coalesce("facets", F.expr(_NONE)).alias("facets"))))
    at = lambda c: F.min_by(c, "seq").alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    whole = first.groupBy("node").agg(at("title"), at("body"), at("file"), come.alias("come"), F.bool_or(F.coalesce("private", F.lit(False))).alias("private"), last("predicate"), last("outcome"))
    every = lambda f: F.array_distinct(F.flatten(F.transform("come", lambda c: c[f]))).alias(f)
    after = whole.select(F.col("node").alias("node_id"), "title", "body", every("anchors"), every("facets"), "private", "predicate", "outcome", "file")
    had = nodes.select(F.col("node_id").alias("node"), F.explode("anchors").alias("anchor"), F.lit(BEFORE).cast("long").alias("seq")).unionByName(placed.select("node", F.explode("anchors").alias("anchor"), "seq"))
    added = had.groupBy("node", "anchor").agg(F.min("seq").alias("seq")).groupBy("seq").agg(F.array_sort(F.collect_list("anchor")).alias("added"))
    told = ready.select("seq", "rejected").join(placed.select("seq", "node", "new"), "seq", "left").join(added, "seq", "left")
    action = F.when(F.col("rejected").isNotNull(), "REJECTED").when(F.col("new"), "NEW").otherwise("MERGE")
    return after, told.select("seq", action.alias("action"), F.col("node").alias("node_id"), F.when(action == "MERGE", F.coalesce("added", F.expr(_NONE))).alias("added"), "rejected")
