import glob
import json
import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import activity, throttle
from tidemark.operators.embedding import HashingEmbedder
from tidemark.operators.filters import where
from tidemark.operators.throttle import Bucket
from tidemark.plans import store
from tidemark.sources import kafka
from tidemark.streaming import activity as live
from tidemark.streaming import ingest
from tidemark.streaming.throttle import throttle_stream

# -- event table -----------------------------------------------------------------------------------


def stored(spark, rows):
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp_ms long, key string, value_json string")
    return store.stored_form(df, promote=["s"], block_rows=10).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))


def event(topic, offset, value, ts=None):
    return (topic, 0, offset, offset if ts is None else ts, None, json.dumps({"s": value}))


def contents(spark, path):
    return sorted((r.topic, r.offset, r.value_s) for r in store.read(spark, path).collect())


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "events")
    first = [event("007", i, "a") for i in range(25)]
    assert store.read(spark, path) is None
    assert store.upsert(stored(spark, first), path, dim=2) == "append"
    before = contents(spark, path)
    assert store.upsert(stored(spark, first), path) == "replace" and contents(spark, path) == before
    assert store.upsert(stored(spark, [event("007", 30, "n"), event("b", 1, "n")]), path) == "append"
    assert store.upsert(stored(spark, [event("007", 3, "z"), event("007", 31, "n")]), path) == "replace"
    assert store.upsert(stored(spark, [event("007", 3, "zz")]), path) == "replace"
    after = {(t, o): v for t, o, v in contents(spark, path)}
    assert len(after) == len(contents(spark, path)) == 28
    assert after["007", 3] == "zz" and after["007", 4] == "a" and after["b", 1] == "n"
    # Values are filtered through their own column, topics and blocks through folders.
    plan = store.read(spark, path).filter("value_s = 'z' AND topic = '007' AND offset_block = 0")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value_s,z)" in plan and "PartitionFilters: [isnotnull(topic" in plan


def files_below(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*.parquet")}


def test_nothing_that_was_written_is_touched(spark, tmp_path):
    path = tmp_path / "events"
    store.upsert(stored(spark, [event("t", i, "a") for i in range(20)]), str(path))
    before = files_below(path)
    store.upsert(stored(spark, [event("t", i, "b") for i in range(5, 30)]), str(path))
    store.compact(spark, str(path), str(tmp_path / "compact"))
    after = files_below(path)
    assert before.items() <= after.items() and len(after) > len(before)
    assert contents(spark, str(path)) == contents(spark, str(tmp_path / "compact")) == [("t", i, "b" if i >= 5 else "a") for i in range(30)]


@pytest.mark.parametrize("arrived", [0, 1, 2])
def test_a_write_that_dies_half_way(spark, tmp_path, arrived, monkeypatch):
    """Part of a batch's files become visible, then the job dies; the batch comes again. No row is lost, none is there twice."""
    path = str(tmp_path / "events")
    old = [event("t", i, "old") for i in range(30)]
    store.upsert(stored(spark, old), path)
    batch = [event("t", i, "new") for i in range(20, 60)]
    whole, calls = store._append, []

    def dying(rows, folder, bloom):
        calls.append(folder)
        if len(calls) <= arrived:
            # The first block's file of this write is in place, the rest is not.
            whole(rows.filter("offset_block % 2 = 0"), folder, bloom)
        if len(calls) == max(1, arrived):
            raise RuntimeError("lost the driver")

    monkeypatch.setattr(store, "_append", dying)
    with pytest.raises(RuntimeError):
        store.upsert(stored(spark, batch), path)
    monkeypatch.undo()
    seen = dict(((t, o), v) for t, o, v in contents(spark, path))
    assert all(("t", i) in seen for i in range(30))
    store.upsert(stored(spark, batch), path)
    assert contents(spark, path) == [("t", i, "new" if i >= 20 else "old") for i in range(60)]


def test_look_back_lists_only_its_days(spark, tmp_path):
    path, day = str(tmp_path / "events"), 86_400_000
    rows = [event("t", i, "a", ts=i * day // 4) for i in range(40)]
    store.upsert(stored(spark, rows), path)
    store.upsert(stored(spark, [event("t", 39, "b", ts=39 * day // 4)]), path)
    now = 10 * day
    recent = store.read(spark, path, since_ms=now - 3_600_000 * 6)
    assert {f.split("event_date=")[1][:10] for f in recent.inputFiles()} == {"1970-01-10"}
    assert [r.value_s for r in recent.filter(f"timestamp_ms >= {now - 3_600_000 * 6}").collect()] == ["b"]
    # A look-back over the whole table leaves the folders of other days out too.
    found = where(store.read(spark, path), minutes=360, now_ms=now)
    assert [r.value_s for r in found.collect()] == ["b"]
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ >= 1970-01-10", found._jdf.queryExecution().executedPlan().toString())
    assert store.read(spark, path, since_ms=20 * day) is None and store.read(spark, path, until_ms=day).count() == 8


def test_last_of_a_batch_wins(spark, tmp_path):
    path = str(tmp_path / "events")
    store.upsert(stored(spark, [event("t", 1, "old", 5), event("t", 1, "new", 9), event("t", 1, "older", 1)]), path)
    assert contents(spark, path) == [("t", 1, "new")]


def test_wrong_dimension_fails(spark, tmp_path):
    with pytest.raises(Exception, match="expected vectors of length 3"):
        store.upsert(stored(spark, [event("t", 1, "x")]), str(tmp_path / "events"), dim=3)


def test_compaction_makes_fewer_files(spark, tmp_path):
    path, target = tmp_path / "events", tmp_path / "compact"
    for i in range(4):
        store.upsert(stored(spark, [event("t", i, "x"), event("u", i, "x")]), str(path))
    store.upsert(stored(spark, [event("t", 2, "y"), event("u", 9, "x", ts=86_400_000)]), str(path))
    store.compact(spark, str(path), str(target))
    assert contents(spark, str(target)) == contents(spark, str(path))
    assert len(files_below(target)) == 3 < len(files_below(path))
    store.compact(spark, str(path), str(tmp_path / "day"), last=date(1970, 1, 1))
    assert len(contents(spark, str(tmp_path / "day"))) == 8
    # Writing goes on in the compacted table.
    assert store.upsert(stored(spark, [event("t", 2, "z")]), str(target)) == "replace"
    assert ("t", 2, "z") in contents(spark, str(target))


# -- ingest ----------------------------------------------------------------------------------------


def write_raw(spark, folder, rows):
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary")
    df = df.withColumn("timestamp", F.timestamp_millis(F.col("offset") * 1000)).withColumn(
        "headers", F.array(F.struct(F.lit("trace_id").alias("key"), F.encode(F.lit("t"), "UTF-8").alias("value")),
                           F.struct(F.lit("authorization").alias("key"), F.encode(F.lit("s"), "UTF-8").alias("value")))
    )
    names = [f.split(":")[0].strip() for f in schemas.RAW.split(", ") if not f.startswith("value: ")]
    df.select("topic", "partition", "offset", "timestamp", "key", "value", "headers").write.mode("append").parquet(folder)
    return names


def framed(body, number=7):
    return b"\x00" + number.to_bytes(4, "big") + body


def good_rows(start, count, topic="orders"):
    return [(topic, 0, i, b"k", framed(json.dumps({"id": i, "email": "a@b.co"}).encode())) for i in range(start, start + count)]


def run(spark, folder, base, sink=None, **job):
    registry = spark.createDataFrame([("orders-value", 1, 7, "{}")], schemas.REGISTRY)
    settings = ingest.Job(
        registry, HashingEmbedder(8), sink or ingest.event_table(f"{base}/events", 8), ingest.letter_folder(f"{base}/letters"), **job
    )
    query = ingest.start(kafka.read_files(spark, folder), settings, f"{base}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    return query


def test_ingest_redacts_stores_and_rejects(spark, tmp_path):
    folder, base = str(tmp_path / "raw"), str(tmp_path)
    write_raw(spark, folder, [*good_rows(0, 5), ("orders", 0, 42, b"k1", b"\x00\x01bad-avro"), ("orders", 0, 43, None, None)])
    query = run(spark, folder, base, drop_fields=("email", "authorization"), include_headers=True)
    rows = store.read(spark, f"{base}/events").orderBy("offset").collect()
    assert [r.offset for r in rows] == list(range(5))
    assert all("email" not in r.value_json and "a@b" not in r.text and r.headers == {"trace_id": "t"} for r in rows)
    assert rows[0].embedding == pytest.approx(HashingEmbedder(8).embed([rows[0].text])[0])
    [letter] = spark.read.parquet(f"{base}/letters").collect()
    assert (letter.offset, bytes(letter.raw_value)) == (42, b"\x00\x01bad-avro")
    totals = ingest.committed([json.loads(p.json) for p in query.recentProgress])
    assert totals["records"] == 7 and totals["tombstones"] == 1


def test_headers_stay_out_by_default(spark, tmp_path):
    folder, base = str(tmp_path / "raw"), str(tmp_path)
    write_raw(spark, folder, good_rows(0, 2))
    run(spark, folder, base)
    assert "headers" not in store.read(spark, f"{base}/events").columns


def test_restart_goes_on_and_replay_changes_nothing(spark, tmp_path):
    folder, base = str(tmp_path / "raw"), tmp_path / "a"
    write_raw(spark, folder, good_rows(0, 4))
    run(spark, folder, str(base))
    write_raw(spark, folder, good_rows(4, 3))
    run(spark, folder, str(base))
    ids = [r.event_id for r in store.read(spark, f"{base}/events").orderBy("offset").collect()]
    assert ids == [f"orders:0:{i}" for i in range(7)]
    # The same files under a new checkpoint are a full replay.
    registry = spark.createDataFrame([("orders-value", 1, 7, "{}")], schemas.REGISTRY)
    job = ingest.Job(registry, HashingEmbedder(8), ingest.event_table(f"{base}/events", 8), ingest.DROP)
    ingest.start(kafka.read_files(spark, folder), job, f"{base}/other", {"availableNow": True}).awaitTermination()
    assert [r.event_id for r in store.read(spark, f"{base}/events").orderBy("offset").collect()] == ids


def test_failing_sink_halts_without_skipping(spark, tmp_path, monkeypatch):
    folder, base = str(tmp_path / "raw"), str(tmp_path)
    write_raw(spark, folder, good_rows(0, 3))
    tries = []

    def broken(events, batch_id):
        tries.append(batch_id)
        raise RuntimeError("store is down")

    monkeypatch.setattr(ingest.time, "sleep", lambda s: None)
    with pytest.raises(Exception, match="store is down"):
        run(spark, folder, base, broken)
    assert tries == [0, 0, 0]
    # With the store back the same batch is processed.
    run(spark, folder, base)
    assert store.read(spark, f"{base}/events").count() == 3


def test_counters_go_on_over_restarts(spark, tmp_path):
    """Good and bad records by topic, over two runs and a batch that came twice."""
    folder, base = str(tmp_path / "raw"), str(tmp_path)
    counters = ingest.batch_folder(f"{base}/counters")
    bad = lambda topic, i: (topic, 0, i, None, b"\x00\x00\x00\x00\x07[1]")
    write_raw(spark, folder, [*good_rows(0, 4), bad("orders", 4), bad("clicks", 0), ("clicks", 0, 1, None, None)])
    run(spark, folder, base, counters=counters)
    write_raw(spark, folder, [*good_rows(5, 2), *good_rows(2, 1, "clicks"), bad("clicks", 3)])
    fails = []

    def flaky(rows, batch_id):
        counters(rows, batch_id)
        if not fails:
            fails.append(batch_id)
            raise RuntimeError("after the write")

    run(spark, folder, base, counters=flaky)
    totals = ingest.counter_totals(spark.read.parquet(f"{base}/counters"))
    assert {r.topic: (r.messages_ingested, r.decode_failures, r.next_offset) for r in totals.collect()} == {"orders": (6, 1, 7), "clicks": (1, 2, 4)}
    assert fails and spark.read.parquet(f"{base}/letters").count() == 3


def test_letters_of_another_checkpoint_stay(spark, tmp_path):
    folder = str(tmp_path / "raw")
    write_raw(spark, folder, [*good_rows(0, 1), ("orders", 0, 9, None, b"bad")])
    registry = spark.createDataFrame([("orders-value", 1, 7, "{}")], schemas.REGISTRY)
    job = ingest.Job(registry, HashingEmbedder(8), ingest.event_table(f"{tmp_path}/events", 8), ingest.letter_folder(f"{tmp_path}/letters"))
    for name in ("one", "two"):
        ingest.start(kafka.read_files(spark, folder), job, f"{tmp_path}/{name}", {"availableNow": True}).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/letters").count() == 2


def test_rejects_are_kept_or_waived(spark, tmp_path):
    registry = spark.createDataFrame([("orders-value", 1, 7, "{}")], schemas.REGISTRY)
    with pytest.raises(ValueError, match="cannot be decoded"):
        ingest.start(None, ingest.Job(registry, HashingEmbedder(8), lambda *a: None), str(tmp_path))


def test_other_bodies_in_the_stream(spark, tmp_path):
    """A decode strategy of one's own: the body is a number, 13 cannot be read."""
    folder, base = str(tmp_path / "raw"), str(tmp_path)
    write_raw(spark, folder, [("orders", 0, i, None, framed(str(i).encode())) for i in (1, 13, 2)])

    def numbers(rows, registry):
        text = F.col("body").cast("string")
        return rows.withColumns({"value_json": F.concat(F.lit('{"n":'), text, F.lit("}")), "body_error": F.when(text == "13", F.lit("unlucky"))})

    run(spark, folder, base, bodies=numbers)
    assert [r.value_json for r in store.read(spark, f"{base}/events").orderBy("offset").collect()] == ['{"n":1}', '{"n":2}']
    assert [(r.offset, r.error) for r in spark.read.parquet(f"{base}/letters").collect()] == [(13, "unlucky")]


def test_flush_by_size_and_by_age(spark, tmp_path):
    """Eight files at once come in batches of at most three; a file that comes later is not held back for others."""
    folder, sizes = str(tmp_path / "raw"), []
    for i in range(8):
        write_raw(spark, folder, good_rows(10 * i, 2))
    registry = spark.createDataFrame([("orders-value", 1, 7, "{}")], schemas.REGISTRY)
    job = ingest.Job(registry, HashingEmbedder(8), lambda events, n: sizes.append(events.count()), ingest.DROP)
    files = len(list((tmp_path / "raw").glob("*.parquet")))
    query = ingest.start(kafka.read_files(spark, folder, files_per_trigger=3), job, str(tmp_path / "c"), {"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        assert sum(sizes) == 16 and len(sizes) >= files / 3 and max(sizes) <= 6
        write_raw(spark, folder, good_rows(100, 1))
        query.processAllAvailable()
        assert sum(sizes) == 17
    finally:
        query.stop()


def test_retry_pauses(monkeypatch):
    pauses, calls = [], []
    monkeypatch.setattr(ingest.time, "sleep", pauses.append)

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    ingest.retrying(flaky)
    assert pauses == [0.5, 1.0]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [("a" if i % 3 else "b", 0, i, (i * i * 911) % 500_000) for i in range(300)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp_ms long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("end", 0, 0, 10**9)], df.schema)
    end.write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, stream in (("slots", live.throughput(source())), ("hours", live.rolling(source(), "1 minute", "10 seconds"))):
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.topic, r.slot_ms): r.events for r in spark.table("slots").collect()}
    assert got == {(r.topic, r.slot_ms): r.events for r in activity.throughput(df).collect()}
    for r in spark.table("hours").collect():
        assert r.events == sum(t == r.topic and r.until_ms - 60_000 <= ms < r.until_ms for t, _, _, ms in rows)


def test_repeats_inside_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("x", 1000), ("x", 1500), ("y", 2000)], "event_id string, timestamp_ms long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == ["x", "y"]


# -- throttle --------------------------------------------------------------------------------------


def test_bucket():
    full = Bucket(3, 9_000)
    assert [full.take(0) for _ in range(4)] == [1, 1, 1, 0]
    small = Bucket(4, 1_000)  # one token in 250 ms
    assert small.take(0, 4) == 4 and small.take(0) == 0 and small.retry_after_ms() == 250
    assert [small.take(510) for _ in range(3)] == [1, 1, 0]
    late = Bucket(1, 1000)
    assert late.take(5000) == 1 and late.take(4000) == 0 and late.last == 5000 and late.take(6000) == 1


def brute(calls, capacity, period):
    buckets, out = {}, {}
    for key, n, at in sorted(calls, key=lambda c: (c[2], c[1])):
        bucket = buckets.setdefault(key, Bucket(capacity, period))
        ok = bucket.take(at) == 1
        out[n] = (ok, 0.0 if ok else bucket.retry_after_ms() / 1000)
    return out


def test_throttle_matches_brute_force_with_a_hot_key(spark):
    calls = [("hot" if i % 3 == 0 else f"k{i % 4}", i, (i * 7919) % 4000 // 7 * (1 if i % 5 else 40)) for i in range(1500)]
    df = spark.createDataFrame(calls, "key string, n long, timestamp_ms long")
    for capacity, period in ((3, 100), (1, 1000), (50, 60)):
        got = {r.n: (r.allowed, r.retry_after_sec) for r in throttle.throttle(df, "key", ["n"], capacity, period).collect()}
        expected = brute(calls, capacity, period)
        assert {n: ok for n, (ok, _) in got.items()} == {n: ok for n, (ok, _) in expected.items()}
        assert all(got[n][1] == pytest.approx(expected[n][1]) for n in got)


def test_one_crowded_millisecond(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("n"), F.lit(7).cast("long").alias("timestamp_ms"))
    assert sorted(r.n for r in throttle.throttle(df, "key", ["n"], 5).filter("allowed").collect()) == [0, 1, 2, 3, 4]
    assert throttle.throttle(df, "key", ["n"], 0).filter("allowed").count() == 1000


def test_stream_throttle_equals_batch(spark, tmp_path):
    calls = [("a" if i % 4 else "b", i, i * 13) for i in range(200)]
    df = spark.createDataFrame(calls, "key string, offset long, timestamp_ms long")
    for part in range(2):
        df.filter(F.col("offset").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = throttle_stream(stream, "key", 2, 100).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.offset: r.allowed for r in spark.table("calls").collect()}
    assert len(got) == 200 and sum(got.values()) > 2


def test_throttle_keeps_calls_without_key_or_time(spark):
    rows = [(None, 1, 0), (None, 2, 0), ("k", 3, None), ("k", 4, 0), (None, 5, None)]
    got = {r.n: r.allowed for r in throttle.throttle(spark.createDataFrame(rows, "key string, n long, timestamp_ms long"), "key", ["n"], 1).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_filters_fit_their_files_and_a_replay_makes_no_more_files(spark, tmp_path):
    """A Bloom filter is sized by a file's rows, and a folder gets one file of a write, also where a part of the batch is stored."""
    path, day = str(tmp_path / "events"), 86_400_000
    batch = [event("t", i, "x", ts=i % 5 * day) for i in range(200)]
    store.upsert(stored(spark, batch[:150]), path)
    assert max(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)) < 100_000
    assert store.upsert(stored(spark, batch), path) == "replace"
    assert store.upsert(stored(spark, batch), path) == "replace"
    found = glob.glob(f"{path}/*/event_date=*/topic=*/partition=*/offset_block=*/*.parquet")
    folders = len({os.path.dirname(f) for f in found if "/events/event_date" in f})
    # Two writes of new events and two of replacements, each a file for every folder.
    assert len(found) <= 4 * folders
    assert contents(spark, path) == [("t", i, "x") for i in range(200)]
