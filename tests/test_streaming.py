import random

from quarry.operators import activity
from quarry.streaming import stateful


def run(spark, tmp_path, name, batches, schema, make, mode="append"):
    """Feed batches as files, one per micro-batch, and collect the output."""
    source = tmp_path / name
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_rate_limit_over_batches(spark, tmp_path):
    rng = random.Random(1)
    calls = sorted((f"k{rng.randrange(3)}", i, float(t)) for i, t in enumerate(sorted(rng.randrange(300) for _ in range(60))))
    calls.sort(key=lambda c: c[2])
    want, recent = {}, {}
    for key, i, at in sorted(calls, key=lambda c: (c[2], c[1])):
        recent[key] = [t for t in recent.get(key, []) if at - t <= 60]
        want[i] = len(recent[key]) < 3
        if want[i]:
            recent[key].append(at)
    got = run(spark, tmp_path, "limited", [calls[:20], calls[20:45], calls[45:]], "key string, call_id long, at double", lambda s: stateful.rate_limit(s, 3, 60))
    assert {r["call_id"]: r["allowed"] for r in got} == want
    from pyspark.sql import functions as F

    batch = spark.createDataFrame(calls, "key string, event_id long, at double").withColumn("ts", F.timestamp_seconds("at"))
    assert {r["event_id"]: r["allowed"] for r in activity.rate_limited(batch, 3, 60).collect()} == want


def test_cache_expiry(spark, tmp_path):
    rows = [("a", 1, 0.0), ("a", 2, 50.0), ("b", 3, 55.0)], [("a", 4, 100.0), ("a", 5, 101.0), ("a", 6, 210.0)]
    got = run(spark, tmp_path, "cached", rows, "key string, call_id long, at double", lambda s: stateful.cache(s, 100))
    assert {r["call_id"]: r["hit"] for r in got} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_marker_is_held_back(spark, tmp_path):
    rows = [("s", 1, "hello <<S")], [("s", 2, "X and <<SU")], [("s", 3, "M>> gone")], [("s", 4, "more")]
    got = run(spark, tmp_path, "held", rows, "stream_id string, pos long, text string", lambda s: stateful.hold_back(s, "<<SUM>>"))
    assert "".join(r["text"] for r in got) == "hello <<SX and "


def test_windows_drop_late_events(spark, tmp_path):
    import datetime as dt

    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[("x", t(1), 1.0), ("x", t(1, 30), 2.0)], [("x", t(5), 1.0)], [("x", t(1, 10), 9.0), ("x", t(8), 1.0)], [("x", t(12), 1.0)]]
    got = run(spark, tmp_path, "windows", batches, "event_type string, ts timestamp, value double", lambda s: stateful.windowed(s))
    assert {(r["start"].hour, r["n"], r["total"]) for r in got} == {(1, 2, 3.0), (5, 1, 1.0), (8, 1, 1.0)}


def test_trace_and_index_refresh(spark, tmp_path):
    source = tmp_path / "docs"
    spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(source))
    q = stateful.write_trace(stream(), str(tmp_path / "trace"), str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "trace")).count() == 2
    from quarry.operators.search import postings

    q = stateful.refresh_index(stream(), lambda b: postings(b.withColumnRenamed("text", "t"), text_col="t"), str(tmp_path / "index"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert "batch" in spark.read.parquet(str(tmp_path / "index")).columns
