"""Guessed names, resolved to known symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scores, text
from ..functions.paths import normal
from .retrieval import top_rows

LEAST = 0.04
#: What trigrams must have in common to reach LEAST without a common token.
GRAMS = 0.2
#: Score of a symbol that a learned synonym leads to, at least; how warm a store must be to use them.
SYNONYM, WARM = 0.5, 0.5


def similar_grams(guesses: DataFrame, symbols: DataFrame, least: float = GRAMS) -> DataFrame:
    """(guess, symbol): pairs that may have a trigram similarity of ``least``: they meet under a symbol's rarest
    trigrams, as many as are needed that every similar guess has one of them."""
    own = symbols.select("symbol", F.size("grams").alias("n"), F.explode("grams").alias("gram")).distinct()
    rarity = own.groupBy("gram").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("df", "gram"))
    keys = own.join(rarity, "gram").withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    return guesses.select("guess", F.explode("ask_grams").alias("gram")).distinct().join(keys.select("symbol", "gram"), "gram").select("guess", "symbol").distinct()


def warmth(symbols: DataFrame) -> DataFrame:
    """(warmth): the share of symbols (accesses, useful, missed) that anything is known of."""
    seen = (F.coalesce("accesses", F.lit(0)) > 0) | (F.coalesce("useful", F.lit(0)) > 0) | (F.coalesce("missed", F.lit(0)) > 0)
    return symbols.agg(F.avg(F.when(seen, 1.0).otherwise(0.0)).alias("warmth"))


def resolve(guesses: DataFrame, symbols: DataFrame, k: int = 5, synonyms: DataFrame | None = None, warm: float = 1.0) -> DataFrame:
    """(guess, rank, symbol, file, score, exp_score, via_synonym) for guesses (guess) among symbols (symbol, file
    and, where known, importance, accesses, useful, missed).

    A score is four fifths the share of the guess's tokens that the symbol has, rare ones counting more, and a
    fifth the similarity of their trigrams; a learned synonym (word, symbol) lifts it; symbols of tests count
    less. Symbols under LEAST are left out. Of equal ones the more experienced comes first if the store is
    warm. Pairs are those that share a token, enough rare trigrams or a synonym: all that can reach LEAST.
    """
    for column, kind in (("importance", "double"), ("accesses", "long"), ("useful", "long"), ("missed", "long")):
        if column not in symbols.columns:
            symbols = symbols.withColumn(column, F.lit(0).cast(kind))
    own = symbols.select("symbol", "file", "importance", "accesses", "useful", "missed", F.array_distinct(text.name_tokens(F.col("symbol"))).alias("tokens"), text.trigrams(F.col("symbol")).alias("grams"))
    stats = own.agg(F.count("*").alias("n"), F.max("accesses").alias("most_accesses"), F.max("importance").alias("most_importance"))
    df = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    idf = df.crossJoin(F.broadcast(stats)).select("token", F.log(1 + F.col("n") / (1 + F.col("c"))).alias("idf"))  # one row
    asked = guesses.select("guess", F.array_distinct(text.name_tokens(F.col("guess"))).alias("asked"), text.trigrams(F.col("guess")).alias("ask_grams"))
    weighted = asked.select("guess", F.explode("asked").alias("token")).join(idf, "token", "left").select("guess", "token", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    total = weighted.groupBy("guess").agg(F.sum("idf").alias("total"))
    hit = own.select("symbol", F.explode("tokens").alias("token")).distinct().join(weighted, "token").groupBy("guess", "symbol").agg(F.sum("idf").alias("hit"))
    pairs = hit.select("guess", "symbol").unionByName(similar_grams(asked, own))
    if synonyms is not None and warm >= WARM:
        led = weighted.join(synonyms.select(F.col("word").alias("token"), "symbol"), "token").groupBy("guess", "symbol").agg(F.min("token").alias("via_synonym"))
    else:
        led = hit.select("guess", "symbol", F.lit(None).cast("string").alias("via_synonym")).limit(0)
    pairs = pairs.unionByName(led.select("guess", "symbol")).distinct()
    rows = pairs.join(hit, ["guess", "symbol"], "left").join(led, ["guess", "symbol"], "left").join(total, "guess", "left").join(asked.select("guess", "ask_grams"), "guess").join(own.drop("tokens"), "symbol").crossJoin(F.broadcast(stats))  # one row
    covered = F.when(F.col("total") > 0, F.coalesce("hit", F.lit(0.0)) / F.col("total")).otherwise(0.0)
    vocab = 0.8 * covered + 0.2 * text.jaccard(F.col("ask_grams"), F.col("grams"))
    vocab = F.when(F.col("via_synonym").isNotNull(), F.greatest(vocab, F.lit(SYNONYM))).otherwise(vocab)
    net = F.coalesce("useful", F.lit(0)) - F.coalesce("missed", F.lit(0))
    exp = scores.experience(F.coalesce("accesses", F.lit(0)), F.col("most_accesses"), F.coalesce("importance", F.lit(0.0)), F.col("most_importance"), F.when(net > 0, 1.0).when(net < 0, -0.3).otherwise(0.0))
    penalty = F.when(paths.mentions_test(F.col("file")), 0.6).otherwise(1.0)
    scored = rows.withColumn("vocab", vocab).where(F.col("vocab") >= LEAST).withColumns({"score": F.round(F.col("vocab") * penalty, 4), "exp_score": F.round(exp, 4)})
    by = [F.desc("score"), *([F.desc("exp_score")] if warm >= WARM else []), "symbol", "file"]
    return top_rows(scored, ["guess"], by, k).select("guess", "rank", "symbol", "file", "score", "exp_score", "via_synonym")


def mine_synonyms(log: DataFrame, symbols: DataFrame, least: int = 2) -> DataFrame:
    """(query, symbol, n): symbols that surfaced for a query ``least`` times or more."""
    return log.where("surfaced").join(symbols, "node_id").groupBy("query", "symbol").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def learned_words(mined: DataFrame) -> DataFrame:
    """(word, symbol): words of queries that led to symbols which share no token with the query."""
    asked, own = F.array_distinct(text.name_tokens(F.col("query"))), F.array_distinct(text.name_tokens(F.col("symbol")))
    return mined.where((F.size(asked) > 0) & ~F.arrays_overlap(asked, own)).select(F.explode(asked).alias("word"), "symbol").distinct()


def prose_words(notes: DataFrame, symbols: DataFrame, idf: DataFrame, per_file: int = 3) -> DataFrame:
    """(word, symbol): rare words of notes (file, text) and the first symbols (file, symbol) of the file that the
    note is pinned to, the path's case aside. A word counts that has four letters or more, is no part of the
    file's symbols, and is rare among all symbols: its ``idf`` (token, idf) is 1 or more, or it is none of theirs."""
    path = lambda df: df.withColumn("at", F.lower(normal(F.col("file"))))
    own = path(symbols).groupBy("at").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, per_file).alias("symbols"), F.array_distinct(F.flatten(F.collect_list(text.name_tokens(F.col("symbol"))))).alias("tokens"))
    words = path(notes).join(own, "at").select("symbols", "tokens", F.explode(F.array_distinct(text.name_tokens(F.col("text")))).alias("word")).where((F.length("word") > 3) & ~F.array_contains("tokens", F.col("word")))
    rare = words.join(idf.select(F.col("token").alias("word"), "idf"), "word", "left").where(F.coalesce("idf", F.lit(99.0)) >= 1)
    return rare.select("word", F.explode("symbols").alias("symbol")).distinct()
