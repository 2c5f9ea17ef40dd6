"""Tables where keys begin at nought, values repeat and more rows qualify than short lists hold."""

import os
import random
from collections import Counter

import duckdb
import pytest

from skeinbase import catalog
from skeinbase.operators import circles, freshness, graph, maintenance, reports, retrieval, serving

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def same_rows(spark, tmp_path):
    """Runs a query and its SQL over the small tables, some replaced by what SQL makes of them."""

    def run(name, **changed):
        con = duckdb.connect()
        for file in os.listdir(FOLDER):
            table = file[:-8]
            con.execute(f"COPY ({changed.get(table, 'SELECT * FROM t').replace(' FROM t', f" FROM '{FOLDER}/{file}' t")}) TO '{tmp_path}/{file}' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{file}'")
        df = catalog.queries()[name](spark, str(tmp_path))
        own = sorted(map(tuple, df.collect()), key=repr)
        assert own == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=repr)
        return own

    return run


def test_all_broken_claims_are_told(same_rows):
    assert len(same_rows("broken_claims")) > 10


def test_a_target_may_have_the_key_nought(same_rows):
    part = "SELECT * REPLACE ('one name' AS p_name) FROM t"
    assert {r[2] for r in same_rows("edges_to_targets", part=part)} >= {0}


def shuffled(spark):
    """The rows that all stages of the session have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jvm = sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_name_shared_by_all_does_not_bring_all_pairs_together(spark):
    n = 600
    code = [(i, "code-symbol", "same name", None, f"src/f{i}.py", "same_name", 1.0) for i in range(n)]
    notes = [(10_000 + i, "lesson", f"note {i}", "why", None, None, float(i % 7)) for i in range(n)]
    nodes = spark.createDataFrame(code + notes, "id long, kind string, title string, body string, file string, symbol string, importance double")
    edges = spark.createDataFrame([(10_000 + i, i, "warns_about", True) for i in range(n)] + [(10_001, 10_000 + 6, "supersedes", True)], "src long, dst long, kind string, verified boolean")
    before = shuffled(spark)
    rows = serving.landmines(nodes, edges, nodes.where("kind = 'code-symbol'").select("file"), 3).collect()
    best = sorted(((i % 7, 10_000 + i) for i in range(n) if i != 6), reverse=True)[:3]
    assert len(rows) == 3 * n and {(r.rank, r.node_id) for r in rows} == {(k + 1, b[1]) for k, b in enumerate(best)}
    assert shuffled(spark) - before < 40 * n


def test_queries_of_words_that_all_nodes_have_do_not_meet_each_node(spark):
    n, m = 1500, 300
    nodes = spark.createDataFrame([(i, "lesson" if i % 2 else "code-symbol", f"t{i % 900}", f"src/f{i % 900}.py", None, None, [], float(i % 5)) for i in range(n)], "id long, kind string, title string, file string, symbol string, line int, facets array<string>, importance double")
    anchors = spark.createDataFrame([(i, w) for i in range(n) for w in ("common-word", "word")], "node_id long, term string")
    queries = spark.createDataFrame([(q, w) for q in range(m) for w in ("common", "word")], "qid long, term string")
    edges = spark.createDataFrame([], "src long, dst long, kind string, verified boolean")
    drift = spark.createDataFrame([], "id long, file string, level string")
    before = shuffled(spark)
    rows = reports.all_tracks(queries, nodes, edges, anchors, drift).collect()
    assert shuffled(spark) - before < 40 * (n + m) < n * m
    of = lambda q, track: [r.node_id for r in sorted(rows, key=lambda r: r["rank"]) if (r.qid, r.track) == (q, track)]
    for q in (0, m - 1):
        assert of(q, "result") == [0, 1, 2] and of(q, "code") == [4, 14, 24, 34, 44] and of(q, "knowledge") == [1, 3, 5, 7, 9]


def test_titles_that_share_a_rare_word_only_do_not_leave_the_join(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    titles = [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(500)]
    titles += [" ".join(t.split()[1:] + [rng.choice(words)]) for t in titles[:60]]
    nodes = spark.createDataFrame(list(enumerate(titles)), "node_id long, title string")
    found = {(r.a, r.b): r.similarity for r in retrieval.near_titles(nodes).collect()}
    least = {}
    for i, t in enumerate(titles):
        if t:
            least.setdefault(t, (i, set(t.split())))
    own = sorted(least.values(), key=lambda x: x[0])
    true = {(a, b): round(len(x & y) / len(x | y), 6) for k, (a, x) in enumerate(own) for b, y in own[k + 1 :] if len(x & y) / len(x | y) >= 0.6}
    assert found == true and len(true) > 30
    split = spark.createDataFrame([(i, sorted(w)) for i, w in own], "node_id long, words array<string>")
    met = {tuple(r) for r in retrieval.title_pairs(split, 0.6).collect()}
    assert met >= set(true) and len(met) < 4 * len(true) + 100


def test_cochange_pairs_need_no_join_of_lines_with_themselves(spark):
    rows = [(c, f) for c in range(40) for f in range(c % 14)] + [(None, 1), (None, 2), (7, None)]
    pairs = graph.cochange(spark.createDataFrame(rows, "sha int, file int"))
    expected = Counter((a, b) for c in range(40) for a in range(c % 14) for b in range(c % 14) if a != b and 2 <= c % 14 + (c == 7) <= 12)
    assert {(r.a, r.b): r.commits for r in pairs.collect()} == expected
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_pagerank_ends_where_ranks_stand_still_and_goes_on_where_they_do_not(spark, monkeypatch):
    rounds, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or written(df))
    rng = random.Random(3)
    for edges, most in (([(i, (i + 1) % 6) for i in range(6)], 4), ([(a, b) for a in range(8) for b in {rng.randrange(9) for _ in range(2)}] + [(0, 1), (0, 1)], 60)):
        n = 9 if most == 60 else 6
        rounds.clear()
        ranks = graph.pagerank(spark.range(n).toDF("node"), spark.createDataFrame(edges, "src long, dst long"), rounds=30)
        expected, ways = [1 / n] * n, Counter(a for a, _ in edges)
        for _ in range(30):
            lost = sum(expected[i] for i in range(n) if not ways[i])
            expected = [0.15 / n + 0.85 * (sum(expected[a] / ways[a] for a, b in edges if b == i) + lost / n) for i in range(n)]
        assert {r.node: round(r["rank"], 12) for r in ranks.collect()} == {i: round(x, 12) for i, x in enumerate(expected)}
        assert len(rounds) <= most


def test_chains_leave_no_join_to_the_end(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(0, 30), (30, 31), (50, 51), (51, 50)], "old int, new int")
    heads = graph.chain_head(pairs, depth=6)
    found = {r.node: (r["head"], r.steps) for r in heads.collect()}
    assert found == {i: (min(i + 6, 20), min(6, 20 - i)) for i in range(20)} | {30: (31, 1), 50: (50, 6), 51: (51, 6)}
    assert "Join" not in heads._jdf.queryExecution().optimizedPlan().toString()


def test_components_read_their_pairs_once(spark, monkeypatch):
    plans, written = [], graph.written
    monkeypatch.setattr(circles, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert sorted(map(tuple, circles.strong_components(pairs).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert "Join" not in plans[0]  # what comes in is written before three joins read it


def test_a_files_newest_commit_tells_whether_it_moved(spark):
    rng = random.Random(9)
    commits = spark.createDataFrame([(s, s // 3) for s in range(30)], "sha long, ts long")
    touches = spark.createDataFrame([(rng.randrange(32), f"f{rng.randrange(8)}") for _ in range(60)], "sha long, file string")
    stamps = spark.createDataFrame([(f"f{rng.randrange(10)}", rng.randrange(32)) for _ in range(50)] + [(None, 1), ("f1", None)], "file string, sha long")
    counted = {(r.file, r.sha): r.commits_since > 0 for r in freshness.commits_since(stamps, touches, freshness.commit_rank(commits)).collect()}
    moved = freshness.moved_since(stamps, touches, commits)
    assert {(r.file, r.sha): r.commits_since == 1 for r in moved.collect()} == counted and len(set(counted.values())) == 2
    assert "Window" not in moved._jdf.queryExecution().optimizedPlan().toString()


def test_kinds_are_refined_without_a_window(spark):
    edges = spark.createDataFrame([(1, 2, "depends_on", None, None), (1, 3, "calls", None, None)], "src long, dst long, kind string, refined_from string, run int")
    labels = spark.createDataFrame([(1, 2, "implements"), (1, 2, "guarded_by"), (1, 3, "implements")], "src long, dst long, kind string")
    fine = maintenance.refine(edges, labels, ("implements", "guarded_by"), 9)
    assert sorted(map(tuple, fine.collect())) == [(1, 2, "guarded_by", "depends_on", 9), (1, 3, "calls", None, None)]
    assert "Window" not in fine._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_meet_each_different_term_once(spark):
    n = 400
    index = spark.createDataFrame([(i, t) for i in range(n) for t in ("red-stone", "stone")], "node_id long, term string")
    terms = spark.createDataFrame([(q, "stone", 1) for q in range(3)], "qid long, term string, df long")
    assert sorted(map(tuple, retrieval.phrases(terms, index).collect())) == [("stone", "red-stone"), ("stone", "stone")]
    rows = retrieval.bm25_counted(terms, index).collect()
    assert len(rows) == 3 * n and {r.hits for r in rows} == {2} and len({round(r.relevance, 9) for r in rows}) == 1
