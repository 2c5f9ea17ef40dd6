import random

import corpus_pipeline

from .helpers import WORDS, sentence


def tables(spark, folder):
    rng = random.Random(12)
    more = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: ". ".join(" ".join(rng.choice(more) for _ in range(9)).capitalize() for _ in range(n))
    docs = [(i, text(12)) for i in range(120)]
    docs += [(200 + i, " ".join(w + "###" for w in text(8).split())) for i in range(60)]
    item = " ".join(rng.choice(more) for _ in range(14))
    docs += [(300, docs[0][1]), (301, docs[1][1] + " tail"), (302, text(6) + " " + item.upper() + ". " + text(6)), (303, text(9) + " token = \"" + "0123456789abcdef" * 2 + "\""), (304, docs[0][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs if i < 250 and i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs)


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs = tables(spark, folder)
    own = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = own.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, own, folder)
        out.write.parquet(f"{folder}/out{k}")
        own = spark.read.parquet(f"{folder}/out{k}")
        left.append({r.doc_id for r in own.select("doc_id").collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or own.columns == columns
    bad = set(range(200, 260))
    assert left[0] == set(docs) - bad
    assert left[1] == left[0] - {300, 301, 304}
    assert left[2] == left[1] - {302} and left[3] == left[4] == left[2]
    texts = {r.doc_id: r.text for r in own.collect()}
    assert texts[303].endswith('token = "[SECRET]"') and all(texts[i] == docs[i] for i in left[4] - {303})
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == left[4]


def test_stages_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    own = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        own = stage(spark, own, str(tmp_path))
        assert own.count() == 0
        own = own if "ids" in own.columns else own.select("doc_id", "text", "lang", "source", "n_chars")


def test_stages_take_nulls_and_repeats(spark, tmp_path):
    tables(spark, str(tmp_path))
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, sentence(random.Random(1), 3000), "en", "s", 1), (2, None, "en", None, None)]
    own = spark.read.parquet(f"{tmp_path}/documents.parquet").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, own, str(tmp_path)).count() >= 0
