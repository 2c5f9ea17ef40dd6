"""Line dedup: of a line that several documents have, only the document of least id keeps it.

DataFrame functions only. A pass over the texts writes a hash, a document and a position for each line;
ranges of hashes are sorted by document and position, and each range is read in order: the first document
of a hash holds its lines, those of later documents go. What comes back is one compressed bitmap a
document that loses lines; texts are never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, quoted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\x0c\r"
#: Lines of one key that are at least this share of all lines are hot: there can be so many keys of them, no more.
HOT_KEYS = 4096
#: Keys that a sketch follows, a dozen times as many: its error is 3.5 / 65,536 of all lines.
TRACKED = 49152
#: Sketches meet in so many groups before they meet in one.
SKETCH_GROUPS = 64
WORD = 64


def line_key(line: Column) -> Column:
    """``line`` without white space at its ends, A-Z in lower case and no other letter changed."""
    key = F.btrim(line, F.lit(BLANK))
    plain = F.octet_length(key) == F.length(key)
    # Lower case as Unicode has it is the same, and faster, unless another letter is in upper case or unknown to the JVM.
    other = key.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}&&[^\x00-\x7F]]")
    return F.when(plain | ~other, F.lower(key)).otherwise(F.translate(key, UPPER, UPPER.lower()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit(""))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc, row, pos): 128 bits of the key of each line of at least ``min_chars`` code points, and
    where it stands; ``row`` tells rows of one id apart by a hash of their texts."""
    doc, text = _texts(docs, id_col, text_col)
    lines = docs.select(doc.alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "row", "pos")


def hot_hashes(hashes: DataFrame, keys: int = HOT_KEYS) -> DataFrame:
    """(h1): hashes that may hold one line in ``keys`` or more, at most about that many; by sketches that are
    merged in groups. Whether a hash is in it changes how its lines are dealt, not what becomes of them."""
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")
    parts = hashes.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(h1, {TRACKED})").alias("sketch"), F.count("*").alias("n"))
    whole = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"), F.sum("n").alias("n"))
    top = whole.select("n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {keys})")).alias("x"))
    return top.where(F.col("x.count") * keys >= F.col("n")).select(F.col("x.item").alias("h1"))


def later_lines(hashes: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc, row, pos) of the lines whose key an earlier document has too; null ids are one document, the last.

    ``hashes`` should be written out, as it is read several times. Lines of hot keys stay where they are: their
    least documents, as many as there are hot keys, are aggregated and sent to them. All others go to
    ranges of hashes, each sorted and read once.
    """
    hot = hot_hashes(hashes, hot_keys)
    marked = hashes.join(F.broadcast(hot), "h1", "left_semi")
    firsts = marked.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    near = marked.join(F.broadcast(firsts), ["h1", "h2"])
    order = [F.col("doc").asc_nulls_last(), F.col("pos")]
    ranges = hashes.join(F.broadcast(hot), "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    run = Window.partitionBy("h1", "h2").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = ranges.withColumn("first", F.first("doc").over(run))
    return near.select(far.columns).unionByName(far).where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "row", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc, row, n_dropped, keep) of each document that loses lines; any other keeps all of its own.

    ``keep`` is a bitmap in words of 64 lines, ascending, as (word, bits); a word without an entry keeps all.
    ``row`` is a hash of the text: rows of one id and one text have one bitmap. Lines are as between ``\\n``;
    keys as of :func:`line_key`, of at least ``min_chars`` code points. Only lines of another, smaller id make a
    line go: one document's repeats stay, and so do those of rows with one id. Null ids are one document after
    all others; a null text is an empty line; an empty table gives none.
    """
    gone = later_lines(checkpointed(line_hashes(docs, id_col, text_col, min_chars)), hot_keys)
    words = gone.groupBy("doc", "row", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("drop"))
    maps = words.groupBy("doc", "row").agg(F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits")))).alias("keep"))
    return maps.select("doc", "row", "n_dropped", "keep")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def kept_lines(lines: Column, keep: Column) -> Column:
    """The ``lines`` that a bitmap keeps: slices between the ones that it doesn't."""
    drops = F.flatten(F.transform(keep, lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: w["word"] * WORD + b), lambda p: F.getbit(w["bits"], p % WORD) == 0)))

    def between(all_lines: Column, gone: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
        ends = F.concat(gone, F.array(F.size(all_lines)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(all_lines, a + 1, b - a)))

    return _let(lines, lambda all_lines: _let(drops, lambda gone: between(all_lines, gone)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row: its lines before, the lines it loses, and its text
    without them. For what goes and for nulls see :func:`keep_bitmaps`."""
    doc, text = _texts(docs, id_col, text_col)
    whole = docs.select(doc.alias("id"), text.alias("whole"), F.xxhash64(text).alias("hash"))
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, hot_keys)
    both = whole.join(maps, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("row")), "left")
    lines = F.split("whole", "\n")
    kept = F.when(F.col("keep").isNull(), F.col("whole")).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    return both.select("id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))
