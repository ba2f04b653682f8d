import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import embedding, search
from tidemark.operators.embedding import HashingEmbedder, embed_column
from tidemark.plans import store, vector_index
from tidemark.sources import tables

DDL = "topic string, partition int, offset long, timestamp_ms long, key string, value_json string, embedding array<float>"


def events(spark, rows):
    return spark.createDataFrame([(t, 0, o, 1000 * o, None, v, e) for t, o, v, e in rows], DDL)


@pytest.fixture(scope="module")
def few(spark):
    return events(spark, [
        ("orders", 1, '{"s":"a"}', [1.0, 0.0]), ("orders", 2, '{"s":"b"}', [0.9, 0.1]), ("orders", 3, '{"s":"a"}', [0.5, 0.5]),
        ("clicks", 4, '{"s":"a"}', [0.0, 1.0]), ("clicks", 5, "[1]", None), ("clicks", 6, '{"s":"c"}', [1.0, 0.0]), ("clicks", 7, "{}", [0.0, 0.0]),
    ])


def test_order_ties_and_missing_vectors(few):
    rows = search.search(few, [1.0, 0.0], 10).collect()
    assert [r.event_id for r in rows] == ["clicks:0:6", "orders:0:1", "orders:0:2", "orders:0:3", "clicks:0:4", "clicks:0:5", "clicks:0:7"]
    assert [round(r.score, 3) for r in rows] == [1.0, 1.0, 0.994, 0.707, 0.0, 0.0, 0.0]
    assert rows[5].value_json == "{}"


def test_limits(few):
    assert search.clamp_limit(50, 10) == (10, True) and search.clamp_limit(0) == (1, False) and search.clamp_limit(700) == (700, False)
    capped = search.search(few, [1.0, 0.0], 50, max_results=2)
    assert [r.truncated for r in capped.collect()] == [True, True]
    assert not search.search(few, [1.0, 0.0], 2, max_results=2).first().truncated


def test_filters_threshold_allowlist(few):
    hit = lambda **o: [r.event_id for r in search.search(few, [1.0, 0.0], 10, **o).collect()]
    assert hit(threshold=0.7) == ["clicks:0:6", "orders:0:1", "orders:0:2", "orders:0:3"]
    assert hit(clauses=[{"field": "s", "eq": "a"}], topic="orders") == ["orders:0:1", "orders:0:3"]
    assert hit(topic="clicks", allowlist=["orders"]) == []
    assert hit(minutes=1, now_ms=66_000) == ["clicks:0:6", "clicks:0:7"]


def test_blank_query(few):
    embedder = HashingEmbedder(2)
    assert search.search_text(few, "   ", embedder).count() == 0
    assert search.search_text(few, "word", embedder, limit=2).count() == 2


def test_value_cap(spark):
    long = '{"x":"' + "é" * 20_000 + '"}'
    df = events(spark, [("t", 1, long, [1.0, 0.0]), ("t", 2, '{"x":1}', [1.0, 0.0])])
    a, b = search.search(df, [1.0, 0.0], 2, value_cap=1024).collect()
    assert a.value_truncated and not b.value_truncated and b.value_json == '{"x":1}'
    row = spark.createDataFrame([(a.value_json,)], "j string").select(F.from_json("j", "_truncated boolean, _size_bytes int, _preview string").alias("s")).first().s
    assert row._truncated and row._size_bytes == len(long) and row._preview == long[:896]
    assert search.search(df, [1.0, 0.0], 1, value_cap=0).first().value_json == long


def test_batch_equals_single_searches(spark, data):
    df = tables.vectors(spark, data)
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=64).tolist() for i in range(7)}
    queries = spark.createDataFrame(list(vectors.items()), "query_id int, vector array<double>")
    got = {}
    for r in search.search_batch(df, queries, 9).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.event_id, r.score)
    for i, vector in vectors.items():
        single = [(r.event_id, r.score) for r in search.search(df, vector, 9).collect()]
        assert [got[i][k] for k in sorted(got[i])] == single


def test_batch_in_several_passes(spark, data, monkeypatch):
    df = tables.vectors(spark, data)
    queries = df.filter("offset < 40").select(ids.event_id().alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(tuple(r) for r in search.search_batch(df, queries, 3).collect())
    # Many groups, blocks of five queries, pieces of seven vectors.
    for name, value in (("GROUP_BYTES", 64 * 8 * 30), ("QUERY_BLOCK_BYTES", 64 * 8 * 5), ("PIECE_ROWS", 7)):
        monkeypatch.setattr(search, name, value)
    assert sorted(tuple(r) for r in search.search_batch(df, queries, 3).collect()) == whole
    assert len(whole) == 120


def test_batch_brings_nothing_to_the_driver(spark, data, monkeypatch):
    """Queries stay rows: planning collects numbers only, and no broadcast holds them."""
    df = tables.vectors(spark, data)
    queries = df.select(ids.event_id().alias("query_id"), F.col("embedding").alias("vector"))
    collect, sizes = type(df).collect, []

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows) * len(self.columns))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    out = search.search_batch(df, queries, 2)
    monkeypatch.undo()
    assert sizes == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 2 * df.count()


def test_batch_odd_rows(spark, few):
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), (None, [0.0, 1.0]), ("a2", [0.0, 0.0])], "query_id string, vector array<double>")
    got = search.search_batch(few, queries, 2, with_vectors=True).collect()
    best = {(r.query_id, r["rank"]): (r.event_id, r.embedding) for r in got}
    assert best["a", 1] == ("clicks:0:6", [1.0, 0.0]) and best[None, 1] == ("clicks:0:4", [0.0, 1.0])
    assert {q for q, _ in best} == {"a", None, "a2"} and best["a2", 1][0] == "clicks:0:4"
    assert search.search_batch(few.limit(0), queries, 2).collect() == [] and search.search_batch(few, queries.limit(0), 2).collect() == []

def test_batch_with_many_equal_vectors(spark):
    """A group of copies larger than a batch: the smallest ids win, none is lost."""
    df = spark.range(20_000).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")
    )
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 0.0])], "query_id int, vector array<double>")
    rows = search.search_batch(df, queries, 3).collect()
    expected = sorted(f"t:0:{i}" for i in range(20_000))[:3]
    for q in (1, 2):
        assert [r.event_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == expected


def test_similar_leaves_out_itself(few):
    rows = search.similar(few, "orders:0:1", 2).collect()
    assert [r.event_id for r in rows] == ["clicks:0:6", "orders:0:2"]
    assert [r.event_id for r in search.similar(few, "orders:0:1", 5, allowlist=["orders"]).collect()] == ["orders:0:2", "orders:0:3"]
    for bad in ("clicks:0:5", "orders:0:99", "nope", "orders:-1:0", ":0:1", "orders:x:1"):
        with pytest.raises(search.EventNotFound):
            search.similar(few, bad)
    with pytest.raises(search.EventNotFound):
        search.similar(few, "clicks:0:4", allowlist=["orders"])


def test_similar_batch_equals_similar(spark, data):
    df = tables.vectors(spark, data)
    refs = df.filter("offset in (3, 77, 200)").select(ids.event_id().alias("event_id"))
    got = search.similar_batch(df, refs, 4).collect()
    for (ref,) in refs.collect():
        single = [r.event_id for r in search.similar(df, ref, 4).collect()]
        assert [r.event_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == ref] == single


def pool(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "query_id int, event_id string, score double, embedding array<double>")


def picks(df, k, weight):
    return [r.event_id for r in search.diversify(df, k, weight).orderBy("rank").collect()]


def test_diversity(spark):
    rows = [("a", 0.95, [1.0, 0.0]), ("a_dup", 0.94, [0.99, 0.01]), ("b", 0.80, [0.0, 1.0])]
    assert picks(pool(spark, rows), 2, 0.5) == ["a", "b"]
    assert picks(pool(spark, rows), 3, 1.0) == ["a", "a_dup", "b"]
    assert picks(pool(spark, [("a", 0.9, None), ("b", 0.7, None)]), 2, 0.7) == ["a", "b"]
    # Plain relevance of a row without a vector beats the weighted one of the others.
    assert picks(pool(spark, [("a", 0.9, [1.0, 0.0]), ("n", 0.7, None)]), 2, 0.7) == ["n", "a"]


def test_diverse_search(spark, data):
    df = tables.vectors(spark, data)
    vector = [1.0] + [0.0] * 63
    plain = search.search(df, vector, 15).collect()
    diverse = search.search(df, vector, 5, diverse=True).collect()
    assert len(diverse) == 5 and {r.event_id for r in diverse} <= {r.event_id for r in plain} and diverse[0].event_id == plain[0].event_id
    assert [r["rank"] for r in diverse] == [1, 2, 3, 4, 5]
    queries = spark.createDataFrame([(0, vector)], "query_id int, vector array<double>")
    batch = search.search_batch_diverse(df, queries, 5).orderBy("rank").collect()
    assert [r.event_id for r in batch] == [r.event_id for r in diverse]


def test_pruned_search_is_exact(spark, data):
    df = tables.vectors(spark, data)
    pivots = search.choose_pivots(df, 8)
    celled = search.assign_cells(df, pivots)
    for seed in range(3):
        vector = np.random.default_rng(seed).normal(size=64).tolist()
        full = [r.event_id for r in search.search(df, vector, 10).collect()]
        assert [r.event_id for r in search.search_pruned(celled, pivots, vector, 10).collect()] == full
    near = [r.event_id for r in search.search_pruned(celled, pivots, pivots[0], 1).collect()]
    assert near == [r.event_id for r in search.search(df, pivots[0], 1).collect()]


def test_pruned_search_skips_rows(spark):
    """Two far clusters: the condition leaves the far one out."""
    rows = [("t", i, "{}", [1.0, i / 1000]) for i in range(50)] + [("t", 100 + i, "{}", [-1.0, i / 1000]) for i in range(50)]
    df = events(spark, rows)
    pivots = [[1.0, 0.0], [-1.0, 0.0]]
    out = search.search_pruned(search.assign_cells(df, pivots), pivots, [1.0, 0.0], 5)
    assert [r.offset for r in out.collect()] == [0, 1, 2, 3, 4]


# -- vector index ----------------------------------------------------------------------------------


def clustered(spark, n, seed=3, dim=8, clusters=10):
    """Tight groups of vectors far from each other, with some that have no angle."""
    pick = np.random.default_rng(seed)
    middles = pick.normal(size=(clusters, dim)) * 10
    rows = [("t", i, json.dumps({"n": i}), (middles[i % clusters] + pick.normal(size=dim) * 0.2).tolist()) for i in range(n)]
    rows += [("t", n, "{}", [0.0] * dim), ("t", n + 1, "{}", None)]
    return store.stored_form(events(spark, rows), block_rows=1000), middles


def files_and_rows(df):
    """Files and rows that the scans of the cells read when the plan runs."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage")):
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            m = node.metrics()
            found.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return tuple(map(sum, zip(*found)))


def found_in(df, vector, k):
    return [(r.event_id, r.score) for r in search.search(df, vector, k).collect()]


def test_stored_cells_are_exact_and_read_less(spark, tmp_path):
    path = str(tmp_path / "table")
    rows, middles = clustered(spark, 4000)
    store.upsert(rows, path)
    vector_index.create(spark, path, 12, block_bytes=16_384)
    assert len(vector_index.pivots(spark, path)) == 12
    table = store.read(spark, path)
    for vector in (*middles[:3].tolist(), (middles[0] + 0.1).tolist()):
        got = vector_index.search_table(spark, path, vector, 15).collect()
        assert [(r.event_id, r.score) for r in got] == found_in(table, vector, 15)
        assert json.loads(got[0].value_json)["n"] == got[0].offset
    whole = vector_index.entries(spark, path)
    files, read = files_and_rows(vector_index.find(spark, path, middles[1].tolist(), 15))
    all_files, all_read = files_and_rows(whole)
    assert files <= 3 < all_files and read < all_read / 4 and all_read == 4002
    # Only some of a cell's row groups, where the range of radii is narrow.
    cell = whole.filter(F.col("cell") >= 0).groupBy("cell").count().orderBy(F.desc("count")).first().cell
    radii = [r.radius for r in whole.filter(F.col("cell") == cell).orderBy("radius").collect()]
    part = whole.filter((F.col("cell") == cell) & F.col("radius").between(radii[0], radii[5])).select("radius", "embedding")
    assert files_and_rows(part)[1] < len(radii)


def test_index_follows_the_table(spark, tmp_path):
    """New events, events embedded anew, a replay, and a form that was replaced twice."""
    path = str(tmp_path / "table")
    rows, middles = clustered(spark, 300)
    store.upsert(rows.filter("offset < 200"), path)
    vector_index.create(spark, path, 6)
    store.upsert(rows.filter("offset >= 150"), path)
    moved = rows.filter("offset IN (3, 13, 250)")
    for far in (5, 4):
        store.upsert(moved.withColumn("embedding", F.array(*[F.lit(float(x)) for x in middles[far]]).cast("array<float>")), path)
    table = store.read(spark, path)
    assert table.count() == 302 == vector_index.entries(spark, path).count()
    for vector in (middles[4], middles[5], middles[3], np.zeros(8), -middles[2]):
        for k in (5, 400):
            got = vector_index.search_table(spark, path, vector.tolist(), k).collect()
            assert [(r.event_id, r.score) for r in got] == found_in(table, vector.tolist(), k)
    top = [r.event_id for r in vector_index.search_table(spark, path, middles[4].tolist(), 3).collect()]
    assert top == ["t:0:13", "t:0:250", "t:0:3"]


def test_probes_are_measured(spark, tmp_path):
    path = str(tmp_path / "table")
    rows, _ = clustered(spark, 2000, seed=8, clusters=25)
    store.upsert(rows, path)
    vector_index.create(spark, path, 20)
    table, hits = store.read(spark, path), 0
    asked = [r.embedding for r in rows.filter("offset % 100 = 0").collect() if r.embedding]
    for vector in asked:
        near = {r.offset for r in vector_index.find(spark, path, vector, 10, probes=4).collect()}
        hits += len(near & {r.offset for r in search.search(table, vector, 10).collect()})
    assert hits >= 0.9 * 10 * len(asked)


def test_index_needs_a_table(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(ValueError):
        vector_index.create(spark, path)
    with pytest.raises(ValueError):
        vector_index.find(spark, path, [1.0])
    store.upsert(clustered(spark, 5)[0], path)
    vector_index.create(spark, path, 2)
    with pytest.raises(ValueError):
        vector_index.create(spark, path)


# -- embedders -------------------------------------------------------------------------------------


def test_column_equals_python(spark, data):
    embedder = HashingEmbedder(32)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", embed_column(embedder, F.col("text")).alias("e"))
    for row in docs.collect():
        [vector] = embedder.embed([row.text])
        assert np.allclose(row.e, vector, atol=1e-12)
    assert np.allclose(spark.range(1).select(embed_column(embedder, F.lit("  "))).first()[0], 0)


class Lengths:
    """A model stand-in that counts how often it is asked."""

    dim = 2

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_model_in_workers(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "text string")
    assert [r[0] for r in df.select(embed_column(Lengths, F.col("text"))).collect()] == [[2.0, 1.0], [3.0, 1.0]]
    assert [r[0] for r in df.select(embed_column(Lengths(), F.col("text"))).collect()] == [[2.0, 1.0], [3.0, 1.0]]


def test_stored_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, []), (5, [2.0])], "n int, embedding array<double>")
    out = embedding.normalized(df)
    assert out.schema["embedding"].dataType.elementType.simpleString() == "float"
    assert {r.n: r.embedding and [round(x, 6) for x in r.embedding] for r in out.collect()} == {1: [0.6, 0.8], 2: None, 3: [0.0, 0.0], 4: [], 5: [1.0]}


def test_cache_embeds_only_new_texts(spark):
    first = spark.createDataFrame([("a",), ("b",)], "text string")
    _, cache = embedding.embed_distinct(first, Lengths)
    cache = cache.persist()
    again = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "d"), (4, "c"), (5, None)], "n int, text string")
    out, fresh = embedding.embed_distinct(again, Lengths, cache)
    assert fresh.count() == 2
    assert [(r.n, r.embedding) for r in out.orderBy("n").collect()] == [(i, [1.0, 1.0]) for i in range(5)] + [(5, None)]
    cache.unpersist()


def test_dimension_checks(spark):
    with pytest.raises(ValueError):
        embedding.probe_dim(HashingEmbedder(8), 16)
    embedding.probe_dim(HashingEmbedder(8), 8)
    with pytest.raises(ValueError):
        HashingEmbedder(0)
    df = spark.createDataFrame([([1.0],)], "embedding array<double>")
    assert embedding.assert_dim(df, 1).count() == 1
    with pytest.raises(Exception, match="expected vectors of length 2"):
        embedding.assert_dim(df, 2).collect()
