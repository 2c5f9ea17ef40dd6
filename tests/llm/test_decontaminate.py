import random
import re

import numpy as np

from skeinbase.llm import decontaminate
from skeinbase.llm.suffixes import two_stage

from .helpers import WORDS, empty, frame, sentence, texts

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        own, hit, names = words(t), set(), set()
        for name, body in items:
            b = words(body)
            if name is None or not b:
                continue
            w = min(window, len(b))
            wanted = {tuple(b[s : s + w]) for s in range(len(b) - w + 1)}
            for s in range(len(own) - w + 1):
                if tuple(own[s : s + w]) in wanted:
                    hit |= set(range(s, s + w))
                    names.add(str(name))
        out.append((str(i), len(own), len(hit), tuple(sorted(names))))
    return sorted(out)


def benchmark():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(3, 30))) for i in range(12)]
    return [*items, (20, None), (21, "..."), (None, "river stone"), (22, "quiet"), (23, items[0][1]), (23, items[1][1].upper())]


def run(spark, docs, items):
    found = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((str(r.id), r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in found.collect())


def planted():
    rng = random.Random(8)
    rows = texts(2)
    for k, (_, body) in enumerate(benchmark()[:8]):
        rows.append((200 + k, sentence(rng, 20) + " " + body.title() + "! " + sentence(rng, 9)))
    return rows


def test_matches_brute_force(spark):
    assert run(spark, planted(), benchmark()) == brute(planted(), benchmark())


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert run(spark, planted(), benchmark()) == brute(planted(), benchmark())


def test_empty_tables(spark):
    assert run(spark, planted(), []) == brute(planted(), [])
    assert decontaminate.find_contamination(empty(spark), spark.createDataFrame(benchmark(), "item_id long, text string")).collect() == []


def test_dropping_keeps_clean_rows_with_their_columns(spark):
    docs, items = planted(), benchmark()
    kept = decontaminate.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    clean = sorted(i for i, _, n, _ in brute(docs, items) if not n)
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean
    assert kept.columns == frame(spark, docs).columns


def test_longest_match(spark):
    item = " ".join(WORDS)
    docs = [(1, "x " + " ".join(WORDS[2:14]) + " y"), (2, " ".join(WORDS[:9]))]
    found = {r.id: r.longest for r in decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: 12, 2: 0}


def test_two_stage_sorting():
    rng = random.Random(1)
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 6)):
            top = rng.choice([1, 2, 5])
            text += [rng.randint(1, top) for _ in range(rng.randint(0, 25))] + [0]
        depth = rng.choice([2, 7, 40])
        got = two_stage(np.array(text, np.int16), depth, 5).tolist()
        keys = [tuple(text[i : text.index(0, i)][:depth]) for i in got]
        assert sorted(got) == [i for i, x in enumerate(text) if x] and keys == sorted(keys)
