import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import activity, annotate, budget, models, sampling, topics
from tidemark.plans import catalog

NOW = 1_893_456_000_000  # 2030-01-01 00:00 UTC
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# -- staleness, merges -----------------------------------------------------------------------------


def test_stale(spark):
    ttl = {"schema": 60, "samples": 60, "stats": 60, "inference": 0}
    df = spark.createDataFrame([("t", NOW - 30_000, NOW - 120_000, None, NOW)], "name string, last_schema_refresh_ms long, last_sample_refresh_ms long, last_stats_refresh_ms long, last_inference_refresh_ms long")
    names = spark.createDataFrame([("t",), ("new",)], "topic string")
    got = {(r.topic, r.aspect): r.stale for r in catalog.stale_aspects(df, names, NOW, ttl).collect()}
    assert [got["t", a] for a in catalog.ASPECTS] == [False, True, True, True]
    assert all(got["new", a] for a in catalog.ASPECTS)


def test_ledger(spark):
    df = spark.createDataFrame([("2030-01-01", "p", 0.01), ("2030-01-01", "p", 0.02), ("2030-01-02", "q", 1.0)], "d string, provider string, spend_usd double")
    out = budget.spend_by_day(df.withColumn("day", F.col("d").cast("date")))
    assert {(str(r.day), r.provider): r.spend_usd for r in out.collect()} == {("2030-01-01", "p"): 0.03, ("2030-01-02", "q"): 1.0}


def test_crossing_call_is_admitted(spark):
    df = spark.createDataFrame([("d", i, 0.02) for i in range(3)], "day string, n long, cost double")
    kept = budget.admit(df, ["day"], ["n"], F.col("n"), F.col("cost"), 0.01)
    assert rows(kept, "n", "spent_before") == [(0, 0.0)]


def test_budget_matches_brute_force_for_a_hot_day(spark):
    calls = [("hot" if i % 3 else f"d{i % 5}", i, (i * 7919 % 101) / 1000) for i in range(900)]
    df = spark.createDataFrame(calls, "day string, n long, cost double")
    expected, spent = set(), {}
    for day, n, cost in calls:
        if spent.get(day, 0) < 3_000:
            expected.add(n)
            spent[day] = spent.get(day, 0) + round(cost * 1000)
    for width in (1, 50, 10_000):
        kept = budget.admit(df, ["day"], ["n"], F.floor(F.col("n") / width), F.col("cost"), 3.0)
        assert {r.n for r in kept.collect()} == expected


def test_estimates_mark_rows(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") < 60).alias("w"))
    mark = lambda **o: budget.mark_admitted(df, "k", F.col("w"), **o).filter("admitted").count()
    assert mark(estimate=0.1, spent=0.0, ceiling=1.05) == 11
    assert mark(estimate=0.1, spent=1.0, ceiling=1.0) == 0
    with pytest.raises(ValueError):
        mark(estimate=0.0, spent=0.0, ceiling=1.0)
    assert mark(estimate=0.0, spent=0.0, ceiling=float("inf")) == 60
    assert mark(estimate=0.1, spent=0.0, ceiling=100.0) == 60


# -- annotation ------------------------------------------------------------------------------------


SECRET = "c_contact"


def customer_topic(spark, data):
    """The given customers as one topic: (columns, its records newest first)."""
    rows = spark.read.parquet(f"{data}/customer.parquet").orderBy("c_custkey").limit(9)
    rows = rows.withColumn(SECRET, F.concat(F.translate("c_name", "#", "."), F.lit("@crm.example")))
    rows = rows.withColumn("c_memo", F.concat(F.lit("mail "), SECRET, F.lit(" on "), "c_mktsegment"))
    records = [json.loads(r.j) for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).collect()]
    return rows.dtypes, records[::-1]


@pytest.fixture(scope="module")
def tables(spark, data):
    columns, records = customer_topic(spark, data)
    fields = spark.createDataFrame([("customer", n, k, n == "c_acctbal", None, f"{n} of it" if n == "c_custkey" else None) for n, k in columns], schemas.FIELDS)
    samples = spark.createDataFrame([("customer", 0, i, i, None, json.dumps(r)) for i, r in enumerate(records[::-1])], schemas.SAMPLES)
    names = spark.createDataFrame([("customer", "fp"), ("bare", None)], "name string, schema_fingerprint string")
    return names, fields, samples


def body_of(prompt):
    return json.loads(prompt[prompt.index('{"topic"'):])


def test_prompt(spark, data, tables):
    columns, records = customer_topic(spark, data)
    [row] = annotate.prompts(*tables, drop=[SECRET], max_samples=3).collect()
    body = body_of(row.prompt)
    assert [(f["name"], f["type"]) for f in body["schema"]] == sorted(columns)
    assert {f["name"] for f in body["schema"] if f.get("nullable")} == {"c_acctbal"} and {f["doc"] for f in body["schema"] if "doc" in f} == {"c_custkey of it"}
    assert [s["c_custkey"] for s in body["samples"]] == [r["c_custkey"] for r in records[:3]]
    assert not any(SECRET in s for s in body["samples"]) and not any(r[SECRET] in row.prompt for r in records)
    assert all(r["c_mktsegment"] in s["c_memo"] for r, s in zip(records, body["samples"])) and not row.prompt_truncated
    assert row.prompt.startswith(annotate.INSTRUCTION) and annotate.ANSWER in row.prompt
    short = annotate.prompts(*tables, max_chars=300).first()
    assert len(short.prompt) <= 300 and short.prompt.endswith('"...prompt_truncated"}') and short.prompt_truncated


def test_long_samples_become_previews(spark, tables):
    names, fields, _ = tables
    samples = spark.createDataFrame([("customer", 0, 1, 1, None, json.dumps({"x": "y" * 900}))], schemas.SAMPLES)
    row = annotate.prompts(names, fields, samples).first()
    [sample] = body_of(row.prompt)["samples"]
    assert list(sample) == ["_preview"] and len(sample["_preview"]) == 800 and sample["_preview"].endswith("...trunc") and row.prompt_truncated


def test_cache_key_ignores_sample_order(spark, tables):
    names, _, samples = tables
    key = lambda s, n: annotate.sample_fingerprints(s, n).filter("topic = 'customer'").first().cache_key
    base = key(samples, names)
    assert key(samples.orderBy(F.desc("offset")), names) == base
    assert key(samples, names.withColumn("schema_fingerprint", F.lit("other"))) != base
    assert key(samples.filter("offset > 0"), names) != base


MEANT = {"c_custkey": ("who", 0.875), "c_acctbal": ("what is owed", 0.75), "c_memo": ("unclear", 0.125)}
ANSWER = {
    "description": "One row a customer", "description_confidence": 0.625,
    "field_annotations": {n: {"meaning": m, "confidence": c} for n, (m, c) in MEANT.items()} | {"c_name": {"meaning": ""}},
}


def answer(text=None, cost=0.02):
    text = json.dumps(ANSWER) if text is None else text
    return models.Model("m", lambda prompt: (text, cost))


def test_annotate_and_cache(spark, tables):
    out = annotate.annotate(*tables, answer(), NOW)
    [topic] = out.topics.collect()
    assert (topic.topic, topic.inference_status, topic.description, topic.description_confidence) == ("customer", "inferred", "One row a customer", 0.625)
    notes = rows(out.annotations, "name", "inferred_meaning", "inferred_confidence")
    assert notes == sorted((n, *m) for n, m in MEANT.items())
    assert rows(out.spend, "provider", "spend_usd") == [("m", 0.02)]

    def refuse(prompt):
        raise AssertionError("asked although cached")

    again = annotate.annotate(*tables, models.Model("m", refuse), NOW, cache=out.cache)
    assert again.topics.collect() == [topic] and rows(again.annotations, "name", "inferred_meaning", "inferred_confidence") == notes
    assert again.spend.count() == 0 and again.cache.count() == 0


def test_failures_and_ceiling(spark, tables):
    def broken(prompt):
        raise RuntimeError("down")

    status = lambda *a, **o: annotate.annotate(*tables, *a, NOW, **o).topics.first().inference_status
    assert status(models.Model("m", broken)) == "failed"
    assert status(answer("nope")) == "failed"
    assert status(answer(), spent=1.0, ceiling=1.0) == "disabled"
    assert status(None) == "disabled"
    out = annotate.annotate(*tables, answer("nope"), NOW)
    assert out.cache.count() == 0 and out.spend.first().spend_usd == 0.02


def test_one_call_for_equal_questions(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def complete(prompt):
        (log / f"{prompt}-{uuid.uuid4().hex}").write_text("")
        if prompt == "p3":
            raise RuntimeError("down")
        return prompt.upper(), 0.05

    asked = [("a", "k1", "p1"), ("b", "k1", "p1"), ("b", "k1", "p1"), ("c", "k2", "p2"), ("d", "k3", "p3"), ("e", "k3", "p3"), ("f", None, "p4"), ("g", None, "p4")]
    df = spark.createDataFrame(asked, "who string, cache_key string, prompt string").repartition(3)
    model = models.Model("m", complete, call_usd=0.1)
    got = models.ask(df, model, ["who"], ceiling=1.0).collect()
    assert sorted(r.who for r in got) == sorted(w for w, _, _ in asked)
    assert sorted(f.name[:2] for f in log.iterdir()) == ["p1", "p2", "p3", "p4"]
    for r in got:
        want = next(p for w, k, p in asked if w == r.who)
        assert r.admitted and (r.text, r.error) == ((None, "down") if want == "p3" else (want.upper(), None))
    paid = models.spend_rows(spark.createDataFrame([(r.admitted, r.cost) for r in got], "admitted boolean, cost double"), "m", NOW).agg(F.sum("spend_usd")).first()[0]
    assert paid == pytest.approx(0.15)
    # A ceiling of one estimated call: two calls of half of it are made, in two waves; the rest is turned away for all who asked.
    made = models.ask(df, models.Model("m", lambda p: ("x", 0.05), call_usd=0.1), ["who"], ceiling=0.1).collect()
    assert len({r.cache_key for r in made if r.admitted}) == 2 and len(made) == 8
    assert all(r.text is None and r.cost == 0 for r in made if not r.admitted)


def test_tolerant_answers(spark):
    good = json.dumps({"description": 5, "description_confidence": "0.4", "field_annotations": []})
    texts = [good, f"```json\n{good}\n```", f"well {good} ok", "nope"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    assert rows(annotate.read_answers(df), "n", "readable", "description", "description_confidence") == [(i, i < 3, None, 0.4 if i < 3 else None) for i in range(4)]


def test_cost_by_model(spark):
    df = spark.createDataFrame([("a", 1_000_000, 0), ("b", 0, 1_000_000), ("zz", 1_000_000, 1_000_000)], "m string, i long, o long")
    cost = budget.call_cost(F.col("m"), F.col("i"), F.col("o"), {"a": (1.0, 5.0), "b": (0.15, 0.6)}, (3.0, 15.0))
    assert [r[0] for r in df.select(cost).collect()] == [1.0, 0.6, 18.0]


# -- reading the catalog ---------------------------------------------------------------------------


class Fixed:
    """Three known texts as three known vectors."""

    dim = 3

    def embed(self, texts):
        table = {"billing data": [1.0, 0.0, 0.0], "Billing events": [0.95, 0.05, 0.05], "Clicks": [0.05, 0.95, 0.05]}
        return [table.get(t, [0.0, 0.0, 1.0]) for t in texts]


def test_purpose(spark):
    names = spark.createDataFrame([("clicks", "Clicks", 0.7), ("billing_events", "Billing events", 0.9), ("odd", None, None)], "name string, description string, description_confidence double")
    fields = spark.createDataFrame([("odd", "b", "int", False, None, None), ("odd", "a", "int", False, None, None)], schemas.FIELDS)
    out = topics.topics_by_purpose(names, fields, "billing data", Fixed(), 2).collect()
    assert [r.name for r in out] == ["billing_events", "clicks"] and out[0].description_source == "inferred"
    assert topics.topics_by_purpose(names, fields, " ", Fixed()).count() == 0
    assert [r.name for r in topics.topics_by_purpose(names, fields, "billing data", Fixed(), allowlist=["odd"]).collect()] == ["odd"]
    texts = {r.name: r.purpose for r in topics.purpose_texts(names, fields).collect()}
    assert texts["odd"] == "Kafka topic 'odd' with fields: a, b."


EVENTS = [("orders", 0, i, NOW - i * 60_000, f"k{i}", json.dumps({"id": i % 7})) for i in range(12)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "topic string, partition int, offset long, timestamp_ms long, key string, value_json string")


def test_listing_with_allowlist(spark, events):
    empty = spark.createDataFrame([], schemas.TOPICS)
    out = activity.list_topics(events, empty, ["orders", "clicks"])
    assert rows(out, "topic", "count", "newest_timestamp_ms") == [("clicks", 0, None), ("orders", 12, NOW)]
    assert rows(activity.list_topics(events, empty), "topic", "count") == [("orders", 12)]


def test_describe(spark, events):
    cat = spark.createDataFrame([("orders", "d", 0.5, "inferred")], "name string, description string, description_confidence double, inference_status string")
    schema = spark.createDataFrame([("orders", "id", "long", False, None, None, None)], "topic string, name string, type string, nullable boolean, doc string, inferred_meaning string, inferred_confidence double")
    [row] = topics.describe_topic("orders", events, cat, schema, sample_size=2).collect()
    assert row["count"] == 12 and [s.event_id for s in row.samples] == ["orders:0:0", "orders:0:1"] and row.fields[0].name == "id"
    [shell] = topics.describe_topic("orders", events, cat, schema, allowlist=["other"]).collect()
    assert shell["count"] == 0 and shell.samples is None and shell.fields is None and shell.description is None


def test_examples_are_newest_first(events):
    out = sampling.example_values_of(events, "id", 5).orderBy("example_rank").collect()
    assert [r.example for r in out] == ["0", "1", "2", "3", "4"]


def test_samples(events):
    assert [r.offset for r in sampling.recent_samples(events, 3).orderBy("offset").collect()] == [9, 10, 11]
    assert sampling.recent_samples(events, 0).count() == 0


def test_samples_beyond_the_bound_are_the_same(events, monkeypatch):
    few = rows(sampling.recent_samples(events, 3), *events.columns)
    ranked = rows(sampling.newest_per_topic(events, 2), "offset", "sample_rank")
    monkeypatch.setattr(sampling, "MAX_CHOSEN", 1)
    assert rows(sampling.recent_samples(events, 3), *events.columns) == few
    assert rows(sampling.newest_per_topic(events, 2), "offset", "sample_rank") == ranked == [(0, 1), (1, 2)]


def test_rolling_counts_match_brute_force(spark):
    times = [(i * i * 37_000) % 90_000_000 for i in range(400)]
    df = spark.createDataFrame([("t", t) for t in times], "topic string, timestamp_ms long")
    for r in activity.rolling_activity(df).collect():
        for span, got in ((activity.HOUR_MS, r.messages_last_hour), (activity.DAY_MS, r.messages_last_day)):
            assert got == sum(r.until_ms - span <= t < r.until_ms for t in times)


def test_activity(events):
    [row] = activity.activity_profile(events, NOW + 30_000).collect()
    assert (row.messages_last_hour, row.messages_last_day, row.rate_per_minute_last_hour, row.observed_schema_versions) == (12, 12, 0.2, [])


# -- refresh ---------------------------------------------------------------------------------------


def job(spark, tmp_path, **settings):
    columns, records = customer_topic(spark, DATA)
    rows_ = [("customer", 0, i, NOW - i, r[SECRET], json.dumps(r)) for i, r in enumerate(records)]
    events = spark.createDataFrame(rows_, "topic string, partition int, offset long, timestamp_ms long, key string, value_json string")
    schema = json.dumps({"type": "record", "name": "customer", "fields": [{"name": n, "type": "string"} for n, _ in columns]})
    registry = spark.createDataFrame([("customer-value", 1, 7, schema)], schemas.REGISTRY)
    store = catalog.CatalogTables(spark, str(tmp_path / "catalog"))
    return catalog.Refresh(store, catalog.Sources(events, registry, model=answer()), catalog.Settings(drop_fields=(SECRET,), **settings))


def test_refresh(spark, tmp_path):
    refresh = job(spark, tmp_path)
    log = refresh.once(["customer", "ghost"], NOW)
    assert [(a, r) for a, r, *_ in log] == [(a, "ok") for a in (*catalog.ASPECTS, "relationships")], log
    read = refresh.tables.read
    by_name = {r.name: r for r in read("topics").collect()}
    assert by_name["customer"].schema_subject == "customer-value" and by_name["customer"].inference_status == "inferred"
    assert by_name["ghost"].schema_subject is None and by_name["ghost"].inference_status == "pending"
    assert by_name["customer"].description == "One row a customer" and by_name["ghost"].last_stats_refresh_ms == NOW
    _, records = customer_topic(spark, DATA)
    sampled = read("samples").collect()
    assert len(sampled) == len(records) and not any(r[SECRET] in s.value_json + s.key or SECRET in s.value_json for r in records for s in sampled)
    assert rows(read("annotations"), "name") == [(n,) for n in sorted(MEANT)]
    assert rows(read("activity"), "topic", "messages_last_hour") == [("customer", len(records)), ("ghost", 0)]
    assert refresh.spent("m", NOW) == pytest.approx(0.02)
    # Nothing is stale a moment later; after a minute only the counters are.
    assert [a for a, *_ in refresh.once(["customer"], NOW + 1)] == ["relationships"]
    assert [a for a, *_ in refresh.once(["customer"], NOW + 60_000, relationships=False)] == ["stats"]
    assert catalog.ensure_fresh(refresh, "customer", NOW + 60_001).first().last_stats_refresh_ms == NOW + 60_000
    assert read("runs").count() == 7


def test_registry_outage_keeps_fields(spark, tmp_path):
    refresh = job(spark, tmp_path)
    refresh.once(["customer"], NOW, relationships=False)
    refresh.sources.registry = spark.createDataFrame([], schemas.REGISTRY)
    refresh.once(["customer"], NOW + 10**9, relationships=False)
    assert refresh.tables.read("fields").count() == len(customer_topic(spark, DATA)[0])
    assert refresh.tables.read("topics").first().schema_id == 7
    # A refresh of the schema does not wipe what was inferred.
    assert refresh.tables.read("annotations").count() == len(MEANT)


def test_samples_are_not_retained_on_request(spark, tmp_path):
    refresh = job(spark, tmp_path, retain_samples=False)
    refresh.once(["customer"], NOW, relationships=False)
    assert refresh.tables.read("samples").count() == 0
    assert refresh.tables.read("topics").first().inference_status == "inferred"


def test_failing_aspect_does_not_stop_the_others(spark, tmp_path):
    refresh = job(spark, tmp_path)

    def broken(events, count):
        raise RuntimeError("no broker")

    refresh.sources.sampler = broken
    log = {a: (r, e) for a, r, _, e, _ in refresh.once(["customer"], NOW)}
    assert log["samples"] == ("error", "no broker") and log["stats"][0] == "ok" and log["inference"][0] == "ok"
    assert catalog.stale_aspects(refresh.tables.read("topics"), spark.createDataFrame([("customer",)], "topic string"), NOW, refresh.settings.ttl()).filter("stale").first().aspect == "samples"


def test_one_bad_topic_does_not_stop_the_others(spark, tmp_path):
    refresh = job(spark, tmp_path)
    asked = []

    def sampler(events, count):
        names = {r.topic for r in events.select("topic").distinct().collect()}
        asked.append(names)
        if "customer" in names:
            raise RuntimeError("no broker for customer")
        return sampling.recent_samples(events, count)

    other = refresh.sources.events.withColumn("topic", F.concat(F.lit("t"), F.col("offset")))
    refresh.sources.events = refresh.sources.events.unionByName(other)
    refresh.sources.sampler = sampler
    names = ["customer", *[f"t{i}" for i in range(9)]]
    log = [r for r in refresh.once(names, NOW, relationships=False) if r[0] == "samples"]
    assert [(r, e, t) for _, r, _, e, t in log] == [("ok", None, None), ("error", "no broker for customer", "customer")]
    assert {r.topic for r in refresh.tables.read("samples").collect()} == {f"t{i}" for i in range(9)} and len(asked) <= 9
    stale = catalog.stale_aspects(refresh.tables.read("topics"), spark.createDataFrame([(n,) for n in names], "topic string"), NOW, refresh.settings.ttl())
    assert rows(stale.filter("stale AND aspect = 'samples'"), "topic") == [("customer",)]
    assert refresh.tables.read("runs").filter("topic = 'customer'").count() == 1


def test_a_broken_source_is_not_asked_for_every_topic(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MAX_FAILING", 2)
    refresh, calls = job(spark, tmp_path), []

    def step(names, now_ms):
        calls.append(names)
        raise RuntimeError("down")

    log = refresh._tracked("samples", step, [f"t{i}" for i in range(64)], NOW)
    assert len(log) == 64 and {r[1] for r in log} == {"error"} and {r[4] for r in log} == {f"t{i}" for i in range(64)}
    assert len(calls) < 12


def test_a_write_without_marks_is_not_seen(spark, tmp_path, monkeypatch):
    tables = catalog.CatalogTables(spark, str(tmp_path / "c"))
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "topic string")
    notes = lambda *found: spark.createDataFrame([(t, n, "m", 1.0) for t, n in found], schemas.ANNOTATIONS)
    assert tables.read("annotations").count() == 0
    tables.replace("annotations", notes(("a", "x"), ("a", "y"), ("b", "x")), keys("a", "b", "c"))
    whole = type(keys("a")).distinct

    def dying(self):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(type(keys("a")), "distinct", dying)
    with pytest.raises(RuntimeError):
        tables.replace("annotations", notes(("a", "lost")), keys("a"))
    monkeypatch.setattr(type(keys("a")), "distinct", whole)
    assert rows(tables.read("annotations"), "topic", "name") == [("a", "x"), ("a", "y"), ("b", "x")]
    tables.replace("annotations", notes(("a", "z")), keys("a", "b"))
    assert rows(tables.read("annotations"), "topic", "name") == [("a", "z")]
    fresh = catalog.compact(tables, str(tmp_path / "d"))
    assert rows(fresh.read("annotations"), "topic", "name") == [("a", "z")]


def test_appending_reads_nothing(spark, tmp_path, monkeypatch):
    tables = catalog.CatalogTables(spark, str(tmp_path / "c"))
    spend = lambda usd: spark.sql(f"SELECT DATE'2030-01-01' day, 'p' provider, {usd}D spend_usd")
    monkeypatch.setattr(catalog.CatalogTables, "_scan", lambda *a: pytest.fail("read"))
    for usd in (1.0, 2.0):
        tables.append("spend", spend(usd))
    monkeypatch.undo()
    assert rows(tables.read("spend"), "spend_usd") == [(1.0,), (2.0,)]
    with pytest.raises(ValueError):
        tables.append("fields", spend(1.0))


def test_topics_are_folded_by_column(spark, tmp_path):
    tables = catalog.CatalogTables(spark, str(tmp_path / "c"))
    write = lambda **v: tables.update_topics(spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {'long' if k.endswith('ms') else 'string'}" for k in v)))
    write(name="a", schema_subject="s1", last_schema_refresh_ms=1)
    write(name="a", description="d", inference_status="inferred")
    write(name="a", schema_subject=None, last_schema_refresh_ms=9)
    write(name="b", last_stats_refresh_ms=3)
    for t in (tables, catalog.compact(tables, str(tmp_path / "d"))):
        got = {r.name: (r.schema_subject, r.description, r.inference_status, r.last_schema_refresh_ms, r.last_stats_refresh_ms) for r in t.read("topics").collect()}
        assert got == {"a": ("s1", "d", "inferred", 9, None), "b": (None, None, "pending", None, 3)}


def test_loop(spark, tmp_path):
    refresh = job(spark, tmp_path)
    catalog.refresh_loop(refresh, ["customer"], 0.0, cycles=2)
    assert refresh.tables.read("topics").count() == 1


def test_fields_of_every_event_type(spark, data, tmp_path):
    """An event type that no list names has its fields in the catalog and its rows in explain_field."""
    from check import TABLES, compare, connect
    from tidemark.plans import queries_catalog

    for name in TABLES:
        if name != "events":
            (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    events = spark.read.parquet(f"{data}/events.parquet")
    other = F.when(F.col("event_id") % 3 == 0, "refund").otherwise(F.col("event_type"))
    events.withColumn("event_type", other).write.parquet(f"file://{tmp_path}/events.parquet")
    con = connect(data)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("catalog_view", "describe_topic", "explain_field"):
        ok, note = compare(con, queries_catalog.QUERIES[name](spark, str(tmp_path)), queries_catalog.ORACLES[name])
        assert ok, (name, note)


def test_many_topics_are_ranked_once(spark, monkeypatch):
    """With more topics than coordinates may be broadcast, no rank of coordinates is made and written first."""
    rows = [(f"t{i % 9}", i % 2, i, 1000 - i, f"v{i}") for i in range(200)]
    events = spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp_ms long, value_json string")
    few = sorted(map(tuple, sampling.recent_samples(events, 3).collect()))

    def refuse(*_):
        raise AssertionError("ranked coordinates first")

    monkeypatch.setattr(sampling, "MAX_CHOSEN", 20)
    monkeypatch.setattr(sampling, "written_once", refuse)
    assert sorted(map(tuple, sampling.recent_samples(events, 3).collect())) == few


def test_calls_are_admitted_without_their_prompts(spark, monkeypatch):
    """Prompts meet the admitted keys in one join; running totals and waves carry keys only."""
    seen, whole = [], budget.mark_admitted

    def watch(calls, *rest):
        seen.append(set(calls.columns))
        return whole(calls, *rest)

    monkeypatch.setattr(models.budget, "mark_admitted", watch)
    asked = spark.createDataFrame([(f"k{i % 6}", f"p{i % 6}", i) for i in range(12)], "cache_key string, prompt string, n int")
    answers = models.ask(asked, models.Model("local", lambda prompt: (f"about {prompt}", 0.1)), ["n"], ceiling=0.45, estimate=0.2).collect()
    assert len(answers) == 12 and all(r.text == f"about p{r.n % 6}" for r in answers if r.admitted)
    assert len(seen) > 1 and all("prompt" not in columns for columns in seen)
