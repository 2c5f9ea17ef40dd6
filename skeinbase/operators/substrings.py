"""Which of many names stand anywhere in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names meet texts under runs of so many characters; shorter names under themselves.
RUN = 3


def runs(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters; none in a shorter text."""
    return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: (i > 0) & (i <= F.length(text) - n + 1)), lambda i: text.substr(i, n)))


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of each text (id, text) and each name (name) that is part of it, case aside: no word's bounds count, and
    no character has a meaning. Empty names and null texts are in none.

    A name meets only texts that have its rarest run of three characters: the rows joined are as many as there are texts with
    that run, not all pairs. A name one of whose runs is in no text is given up before.
    """
    low = texts.where("text is not null").select("id", F.lower("text").alias("low"))
    own = names.where("name is not null and name <> ''").select("name", F.lower("name").alias("wanted")).distinct()
    length = F.least(F.length("wanted"), F.lit(RUN))
    asked = own.select("name", "wanted", length.alias("n"), F.explode(runs(F.col("wanted"), length)).alias("run"))
    have = low.select("id", "low", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(RUN)), lambda n: runs(F.col("low"), n)))).alias("run"))
    have = have.join(asked.select("run").distinct(), "run", "left_semi")
    often = have.groupBy("run").agg(F.count("*").alias("often"))
    per = Window.partitionBy("name")
    counted = asked.join(often, "run", "left").withColumn("lost", F.max(F.col("often").isNull()).over(per)).where("not lost")
    rarest = counted.withColumn("at", F.row_number().over(per.orderBy("often", "run"))).where("at = 1").select("run", "name", "wanted")
    return have.join(rarest, "run").where(F.contains("low", F.col("wanted"))).select("id", "name")


def first_contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): of the names (name, order) that a text has the first in order, then by name; no row without one."""
    order = names.groupBy("name").agg(F.min("order").alias("order"))
    return contained(texts, names).join(order, "name").groupBy("id").agg(F.min_by("name", F.struct("order", "name")).alias("name"))
