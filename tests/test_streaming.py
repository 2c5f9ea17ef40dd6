import datetime as dt

from pyspark.sql import functions as F

from skeinbase.streaming import activity

SCHEMA = "id long, ts timestamp, kind string, node_id long, surfaced boolean"
START = dt.datetime(2024, 1, 1, 12)


def written(spark, folder, rows):
    spark.createDataFrame([(i, START + dt.timedelta(minutes=m), kind, node, True) for i, m, kind, node in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_sliding_receipt_matches_a_batch(spark, tmp_path):
    rows = [(i, i * 37, "view" if i % 3 else "click", i % 4) for i in range(60)]
    written(spark, f"{tmp_path}/log", rows)
    log = activity.events(spark, f"{tmp_path}/log", SCHEMA)
    got = drained(spark, activity.receipt(log, "2 hours", "1 hour"), "receipt", "complete")
    batch = spark.read.parquet(f"{tmp_path}/log").groupBy(F.window("ts", "2 hours", "1 hour"), "kind").agg(F.count("*").alias("n"))
    assert sorted((r.start, r.kind, r.n) for r in got.collect()) == sorted((r.window.start, r.kind, r.n) for r in batch.collect())


def test_sessions_end_after_a_gap(spark, tmp_path):
    written(spark, f"{tmp_path}/log", [(1, 0, "view", 1), (2, 20, "view", 1), (3, 90, "view", 1), (4, 5000, "view", 2)])
    got = drained(spark, activity.sessions(activity.events(spark, f"{tmp_path}/log", SCHEMA)), "sessions")
    assert sorted((r.node_id, r.n) for r in got.where("node_id = 1").collect()) == [(1, 1), (1, 2)]


def test_acks_expire(spark, tmp_path):
    written(spark, f"{tmp_path}/log", [(1, 0, "ack", 1), (2, 10, "edit", 1), (3, 16, "edit", 1), (4, 0, "edit", 2)])
    got = drained(spark, activity.acks(activity.events(spark, f"{tmp_path}/log", SCHEMA)), "acks")
    assert sorted((r.id, r.acked) for r in got.collect()) == [(2, True), (3, False), (4, False)]


def test_batches_are_handed_over_once(spark, tmp_path):
    seen = []
    for rows in ([(1, 0, "view", 1)], [(2, 1, "view", 1), (3, 2, "view", 1)]):
        written(spark, f"{tmp_path}/log", rows)
        q = activity.incremental(activity.events(spark, f"{tmp_path}/log", SCHEMA), lambda df, n: seen.extend(r.id for r in df.collect()), f"{tmp_path}/offsets")
        q.awaitTermination()
    assert sorted(seen) == [1, 2, 3]
