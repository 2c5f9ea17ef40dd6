"""Snapshot, state block, instructions, migration, stream updates and the adapter."""

import json
import threading
import urllib.request

from pyspark.sql.types import StructType

from skeinbase import adapter
from skeinbase.operators import reports
from skeinbase.plans import serves, store
from skeinbase.streaming import updates

FOLDER = "/root/testdata/sf0.001"


def test_snapshot_is_json(spark):
    rows = {r.section: json.loads(r.json) for r in reports.snapshot(store.nodes(spark, FOLDER), store.edges(spark, FOLDER), serves._drift(spark, FOLDER)).collect()}
    assert set(rows) == {"files", "authors", "drift", "product"} and rows["files"][0]["file"] < rows["files"][-1]["file"] and rows["product"] == []


def test_state_block_is_written_once(tmp_path):
    block = reports.state_block({"files": 2, "broken": 1}, [{"title": "ADR-1"}], [{"title": "x", "file": "a.py"}])
    path = tmp_path / "NOTES.md"
    path.write_text("# Mine\n")
    assert reports.write_block(path, block) and not reports.write_block(path, block)
    other = reports.state_block({}, [], [])
    assert reports.write_block(path, other) and path.read_text() == f"# Mine\n\n{other}\n"


def test_instructions_from_replies(spark):
    replies = [
        (1, 'Here:\n```json\n[{"headline": "One", "why": "because", "keywords": ["engine", "storage"], "tags": ["Sec"]}, {"body": "no title", "anchors": ["engine", "storage"]}]\n```'),
        (2, '{"notes": [{"title": "Two", "anchors": ["engine"]}]} trailing'), (3, "no json here"), (4, None),
    ]
    rows = [(r.id, r.at, r.title, r.body, r.tags, r.dropped) for r in reports.instructions(spark.createDataFrame(replies, "id int, reply string")).orderBy("id", "at").collect()]
    assert rows == [(1, 0, "One", "because", ["security"], None), (1, 1, None, "no title", [], "no title"), (2, 0, "Two", None, [], "too few anchors")]


def test_a_store_opens_with_columns_added_since(spark, tmp_path):
    new = StructType.fromDDL("id long, kind string, outcome string")
    spark.createDataFrame([(1, "lesson")], "id long, kind string").write.parquet(str(tmp_path / "nodes"))
    found = reports.open_store(spark, str(tmp_path), {"nodes": new, "edges": StructType.fromDDL("src long, dst long")})
    assert found["nodes"].collect() == [(1, "lesson", None)] and found["edges"].collect() == []
    assert reports.migrated(found["nodes"], new).columns == ["id", "kind", "outcome"]


def test_a_failed_batch_comes_again_and_ranks_once_each(spark, tmp_path):
    schema = "file string, deleted boolean, at int"
    source, done, ranked, fail = str(tmp_path / "in"), [], [], [True]
    spark.createDataFrame([("a", False, 1), ("a", True, 2), ("b", False, 1)], schema).coalesce(1).write.parquet(source)

    def apply(df):
        if fail.pop() if fail else False:
            raise RuntimeError("once")
        done.extend(sorted((r.file, r.deleted) for r in df.collect()))

    for _ in range(2):
        query = updates.follow(spark.readStream.schema(schema).parquet(source), apply, lambda: ranked.append(1), str(tmp_path / "check"), "100 milliseconds")
        try:
            query.processAllAvailable()
        except Exception:
            pass
        query.stop()
    assert done == [("a", True), ("b", False)] and ranked == [1]
    old, new = (spark.createDataFrame(x, "key string, value string") for x in ([("head", "a"), ("n", "1")], [("head", "b"), ("n", "1"), ("m", "2")]))
    assert sorted((r.key, r.old, r.new) for r in updates.changed(old, new).collect()) == [("head", "a", "b"), ("m", None, "2")]


def test_requests(spark):
    assert "brief" in adapter.handle(spark, FOLDER, {"id": 1, "method": "list"})["result"]
    assert "error" in adapter.handle(spark, FOLDER, {"method": "call", "params": {"name": "none"}}) and "error" in adapter.handle(spark, FOLDER, {})
    web = adapter.server(spark, FOLDER)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{web.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{at}/healthz")) == {"ok": True}
        body = json.dumps({"id": 7, "method": "call", "params": {"name": "pulse", "limit": 1}}).encode()
        assert json.load(urllib.request.urlopen(at, data=body))["result"][0]["nodes"] > 0
    finally:
        web.shutdown()
        web.server_close()


def test_retrieval_is_silent_without_enough_hits(spark):
    nodes = spark.createDataFrame([(1, "lesson", "t", None, None, None, ["chore"], 1.0), (2, "lesson", "u", None, None, None, [], 1.0)], "id long, kind string, title string, file string, symbol string, line int, facets array<string>, importance double")
    edges = spark.createDataFrame([], "src long, dst long, kind string, verified boolean")
    anchors = spark.createDataFrame([(1, "engine"), (1, "storage"), (2, "engine")], "node_id long, term string")
    drift = spark.createDataFrame([], "id long, file string, level string")
    asked = spark.createDataFrame([(1, "engine"), (1, "storage")], "qid long, term string")
    assert [(r.qid, r.track) for r in reports.all_tracks(asked, nodes, edges, anchors, drift).collect()] == [(1, "silenced")]
    assert sorted((r.track, r.node_id) for r in reports.all_tracks(asked, nodes, edges, anchors, drift, silent=()).collect()) == [("knowledge", 1), ("knowledge", 2), ("result", 1)]
