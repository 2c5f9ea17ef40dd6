import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from skeinbase.llm import lines

from .helpers import empty, frame

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least=10):
    """(id, n_lines, n_dropped, kept) of every row; null ids are one document after all others."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key_of(line)
            if len(k) >= least:
                first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key_of(x)) < least or first[key_of(x)] == order(i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LICENCE = "This line stands in every document of the table."
ROWS = [
    (5, f"{LICENCE}\nown line of number five\n\n{LICENCE}"), (3, f"a\n  {LICENCE.upper()} \t\nown line of number three\nshort"), (9, None), (8, ""), (7, "\n\n"), (2, "short\nÄÖÜ ist groß genug\nİstanbul ΣΑΣ lines"),
    (6, "äÖü ist groß genug\nÄÖÜ IST GROß genug\ni̇stanbul σας lines\nİSTANBUL ΣΑΣ LINES\r"), (4, f"{LICENCE}\n" * 300 + "the end of number four"), (None, f"{LICENCE}\na line of none at all"), (None, "a line of none at all\nown line of number five"),
    (10, "\xa0exactly ten\xa0"), (11, "\xa0exactly ten\xa0\nnine char"), (12, "nine char\nten chars!"), (13, "TEN CHARS!\v"), (5, f"{LICENCE}\nown line of number five\n\n{LICENCE}"), (5, "another row of five\nown line of number three"), (14, "x" * 70000 + "\n" + "x" * 70000),
]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    assert got(lines.dedup_lines(frame(spark, ROWS))) == brute(ROWS)


def test_hot_and_cold_keys_are_decided_alike(spark):
    for keys in (1, 3, 4096):
        assert got(lines.dedup_lines(frame(spark, ROWS), hot_keys=keys)) == brute(ROWS)


def test_shorter_and_longer_lines(spark):
    for least in (0, 1, 30):
        assert got(lines.dedup_lines(frame(spark, ROWS), min_chars=least)) == brute(ROWS, least)


def test_other_column_names(spark):
    df = spark.createDataFrame([("b", LICENCE, 1, "x"), ("a", LICENCE, 2, "y")], "`key.1` string, `the text` string, row int, h1 string")
    assert got(lines.dedup_lines(df, "key.1", "the text")) == [("a", 1, 0, LICENCE), ("b", 1, 1, "")]


def test_bitmaps_are_of_documents_that_lose_lines(spark):
    maps = {(r["doc"], r["n_dropped"]): [tuple(w) for w in r["keep"]] for r in lines.keep_bitmaps(frame(spark, ROWS)).collect()}
    all_gone = {k: sum(64 - bin(bits & (2**64 - 1)).count("1") for _, bits in v) for k, v in maps.items()}
    assert all(k[1] == n > 0 for k, n in all_gone.items())
    assert [w for w, _ in maps[(4, 300)]] == [0, 1, 2, 3, 4]
    assert 8 not in {k[0] for k in maps} and 3 not in {k[0] for k in maps}


def test_no_rows(spark):
    assert got(lines.dedup_lines(empty(spark))) == []
    assert lines.keep_bitmaps(empty(spark)).count() == 0


def test_keys_lower_no_letters_but_a_to_z(spark):
    every = [chr(c) for c in range(1, 0x2FA20) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, f"X{c}X") for i, c in enumerate(every)], "i int, s string")
    own = dict(df.select("i", lines.line_key(F.col("s"))).collect())
    assert all(own[i] == key_of(f"X{c}X") for i, c in enumerate(every))


def test_one_shuffle_of_lines_and_no_python(spark):
    hashes = spark.range(1000).select((F.col("id") % 7).alias("h1"), (F.col("id") % 5).alias("h2"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("pos"))
    plan = lines.later_lines(hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
    window = plan[plan.index("Window") :]
    assert window.index("Sort") < window.index("Exchange")
    assert "rangepartitioning" in window[window.index("Exchange") : window.index("Exchange") + 60]


def test_same_texts_many_times(spark):
    rows = [(i % 5, f"{LICENCE}\nmore of the same in row after row") for i in range(3000)]
    found = lines.dedup_lines(frame(spark, rows, 7)).groupBy("id", "n_dropped").count().collect()
    assert sorted(map(tuple, found)) == [(0, 0, 600), (1, 2, 600), (2, 2, 600), (3, 2, 600), (4, 2, 600)]
    assert hashlib.sha256(b"").hexdigest() == lines.dedup_lines(frame(spark, rows, 7)).where("id = 4").select(F.sha2("kept", 256)).first()[0]
