"""Registered queries: relationships between topics, throttling, the ingest stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import models, relations, throttle
from tidemark.operators.embedding import HashingEmbedder
from tidemark.plans import inputs, store
from tidemark.plans.queries_events import ERROR, EV, NOW, RAW
from tidemark.session import shared_dir
from tidemark.sources import registry, tables
from tidemark.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: Identifier columns of the relational topics: (topic, field, base type, table, column).
KEYS = (
    ("customers", "customer_id", "long", "customer", "c_custkey"),
    ("customers", "nation_id", "int", "customer", "c_nationkey"),
    ("suppliers", "supplier_id", "long", "supplier", "s_suppkey"),
    ("suppliers", "nation_id", "int", "supplier", "s_nationkey"),
    ("parts", "part_id", "long", "part", "p_partkey"),
    ("orders", "order_id", "long", "orders", "o_orderkey"),
    ("orders", "customer_id", "long", "orders", "o_custkey"),
    ("lineitems", "order_id", "long", "lineitem", "l_orderkey"),
    ("lineitems", "part_id", "long", "lineitem", "l_partkey"),
    ("lineitems", "supplier_id", "long", "lineitem", "l_suppkey"),
    ("documents", "doc_id", "long", "documents", "doc_id"),
    ("labels", "doc_id", "long", "labels", "doc_id"),
    ("nations", "nation_id", "int", "nation", "n_nationkey"),
)
OBS = "obs AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS topic, '{f}' AS field, '{k}' AS type, CAST({c} AS VARCHAR) AS value FROM {src} WHERE {c} IS NOT NULL"
    for t, f, k, src, c in KEYS
) + ")"
ROWS = "rowcount AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS topic, '{f}' AS field, '{k}' AS type, count({c}) AS n FROM {src}" for t, f, k, src, c in KEYS
) + ")"
OVERLAP = OBS + """, size AS (SELECT topic, field, type, count(*) AS n FROM obs GROUP BY 1, 2, 3),
  shared AS (SELECT a.topic AS s, b.topic AS t, a.field, count(*) AS n FROM obs a JOIN obs b ON a.field = b.field AND a.value = b.value AND a.topic <> b.topic GROUP BY 1, 2, 3),
  ov AS (SELECT a.topic AS source_topic, b.topic AS target_topic, a.field, a.type, coalesce(shared.n, 0) AS shared_values, a.n AS source_values,
    b.n AS target_values, coalesce(shared.n, 0)::DOUBLE / least(a.n, b.n) AS overlap
    FROM size a JOIN size b ON a.field = b.field AND a.type = b.type AND a.topic <> b.topic
    LEFT JOIN shared ON shared.s = a.topic AND shared.t = b.topic AND shared.field = a.field)"""
EDGES = OVERLAP + """, edges AS (SELECT source_topic, target_topic,
    CASE WHEN field IN ('id', 'uuid', 'pk') OR field = concat(target_topic, '_id') OR field = concat(regexp_replace(target_topic, 's$', ''), '_id')
      THEN 'foreign_reference' ELSE 'shared_key' END AS relationship_type, field AS source_field, field AS target_field,
    least(0.95, 0.55 + overlap / 2)::DOUBLE AS confidence,
    concat('Field ''', field, ''' matches in both topics with type ', type, '; sample overlap ratio ', printf('%.2f', overlap), '.') AS rationale
    FROM ov WHERE overlap >= 0.2)"""


def _fields(spark, folder):
    topics = tables.relational(spark, folder)
    return topics, registry.fields_of(spark, {name: df.schema for name, df in topics.items()})


def _edges(spark, folder):
    topics, fields = _fields(spark, folder)
    return topics, fields, relations.table_edges(fields, topics, NOW)


@query(
    f"""WITH {ROWS} SELECT a.topic AS source_topic, b.topic AS target_topic, a.field, a.n AS source_rows, b.n AS target_rows
    FROM rowcount a JOIN rowcount b ON a.field = b.field AND a.type = b.type AND a.topic <> b.topic"""
)
def candidate_keys(spark, folder):
    """Candidate pairs with the number of rows that carry the key on either side."""
    topics, fields = _fields(spark, folder)
    pairs = relations.candidate_keys(fields)
    rows = relations.observe_tables(topics, pairs).groupBy("topic", "field").agg(F.count(F.lit(1)).alias("n"))
    source = rows.select("field", F.col("topic").alias("source_topic"), F.col("n").alias("source_rows"))
    target = rows.select("field", F.col("topic").alias("target_topic"), F.col("n").alias("target_rows"))
    joined = pairs.join(source, ["field", "source_topic"]).join(target, ["field", "target_topic"])
    return joined.select("source_topic", "target_topic", "field", "source_rows", "target_rows")


@query(
    f"WITH {OVERLAP} SELECT source_topic, target_topic, field, shared_values, source_values, target_values, round(overlap, 9) AS overlap FROM ov"
)
def value_overlap(spark, folder):
    topics, fields = _fields(spark, folder)
    pairs = relations.candidate_keys(fields)
    out = relations.value_overlap(relations.observe_tables(topics, pairs), pairs)
    return out.select(
        "source_topic", "target_topic", "field", "shared_values", "source_values", "target_values", F.round("overlap", 9).alias("overlap")
    )


@query(f"WITH {EDGES} SELECT * REPLACE (round(confidence, 9) AS confidence) FROM edges")
def shared_keys(spark, folder):
    return _edges(spark, folder)[2].drop("last_refresh_ms").withColumn("confidence", F.round("confidence", 9))


NAMES = "names AS (SELECT unnest(['customers', 'suppliers', 'parts', 'orders', 'lineitems', 'documents', 'labels', 'nations']) AS name)"
UNRELATED = f"""{NAMES}, un AS (SELECT x.name AS a, y.name AS b FROM names x JOIN names y ON x.name < y.name
  WHERE NOT EXISTS (SELECT 1 FROM edges WHERE (source_topic = x.name AND target_topic = y.name) OR (source_topic = y.name AND target_topic = x.name)))"""


@query(f"WITH {EDGES}, {UNRELATED} SELECT a, b FROM un")
def unrelated_pairs(spark, folder):
    _, fields, edges = _edges(spark, folder)
    return relations.unrelated_pairs(fields.select(F.col("topic").alias("name")).distinct(), edges)


@query(
    f"""WITH {EDGES} SELECT unnest(CASE WHEN source_topic IN ('orders', 'suppliers') AND target_topic IN ('orders', 'suppliers') THEN [source_topic, target_topic]
      WHEN source_topic IN ('orders', 'suppliers') THEN [source_topic] ELSE [target_topic] END) AS topic,
    source_topic, target_topic, source_field, round(confidence, 9) AS confidence FROM edges
    WHERE (source_topic IN ('orders', 'suppliers') OR target_topic IN ('orders', 'suppliers')) AND source_topic <> 'nations' AND target_topic <> 'nations'"""
)
def relationship_lookup(spark, folder):
    topics, fields, edges = _edges(spark, folder)
    asked = fields.select("topic").distinct().filter(F.col("topic").isin("orders", "suppliers"))
    found = relations.relationships_of(edges, asked, [t for t in topics if t != "nations"])
    return found.select("topic", "source_topic", "target_topic", "source_field", F.round("confidence", 9).alias("confidence"))


def _scorer(prompt: str) -> tuple[str, float]:
    """A deterministic stand-in: pairs whose names add up to an even length are related."""
    body = json.loads(prompt[prompt.index('{"topic_a"'):])
    a, b = body["topic_a"]["name"], body["topic_b"]["name"]
    even = (len(a) + len(b)) % 2 == 0
    answer = {"related": even, "relationship_type": "causes", "confidence": 0.8 if even else 0.1, "rationale": f"{a} with {b}"}
    return "Here: " + json.dumps(answer), 0.001


@query(
    f"""WITH {EDGES}, {UNRELATED} SELECT source_topic, target_topic, relationship_type, source_field, round(confidence, 9) AS confidence, rationale FROM edges
    UNION ALL SELECT a, b, 'semantic', NULL, 0.8, concat(a, ' with ', b) FROM un WHERE (length(a) + length(b)) % 2 = 0"""
)
def all_relationships(spark, folder):
    _, fields, edges = _edges(spark, folder)
    names = fields.select(F.col("topic").alias("name")).distinct()
    topics = names.select("name", F.lit("fp").alias("schema_fingerprint"), F.lit(None).cast("string").alias("description"))
    scored, _, _ = relations.scored_edges(
        relations.unrelated_pairs(names, edges), topics, fields, models.Model("local", _scorer), NOW
    )
    both = edges.unionByName(scored)
    return both.select(
        "source_topic", "target_topic", "relationship_type", "source_field", F.round("confidence", 9).alias("confidence"), "rationale"
    )


@query(
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def follow_relationship(spark, folder):
    topics = tables.relational(spark, folder)
    builders = topics["customers"].filter(F.col("segment") == "BUILDING")
    return relations.follow(topics["orders"], builders, "customer_id", "customer_id").select("order_id", "customer_id")


@query(f"WITH {EDGES} SELECT source_topic, target_topic, source_field, relationship_type, round(confidence, 9) AS confidence FROM edges")
def evident_edges(spark, folder):
    """The same edges from the topics that share values, without pairing up all topics with a field of one name."""
    topics, fields = _fields(spark, folder)
    observed = relations.observe_tables(topics, relations.candidate_keys(fields)).drop("bit")
    edges = relations.heuristic_edges(fields, observed, NOW)
    return edges.select("source_topic", "target_topic", "source_field", "relationship_type", F.round("confidence", 9).alias("confidence"))


def _described(name: str) -> str:
    return f"""'{{"name":"', {name}, '","schema_fingerprint":"fp-', {name}, '","description":null}}'"""


@query(
    f"""WITH {EDGES}, {UNRELATED} SELECT a, b, concat('rel:', sha256(concat('{{"a":', {_described("a")}, ',"b":', {_described("b")}, '}}'))) AS cache_key FROM un"""
)
def pair_keys(spark, folder):
    """The cache key of every pair without an edge, whichever way round the pair is asked."""
    _, fields, edges = _edges(spark, folder)
    names = fields.select(F.col("topic").alias("name")).distinct()
    topics = names.select("name", F.concat(F.lit("fp-"), "name").alias("schema_fingerprint"), F.lit(None).cast("string").alias("description"))
    pairs = relations.unrelated_pairs(names, edges)
    there = relations.with_pair_prompts(pairs, topics, fields)
    back = relations.with_pair_prompts(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), topics, fields)
    same = there.alias("x").join(back.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.cache_key") == F.col("y.cache_key")))
    return same.select("x.a", "x.b", "x.cache_key")


@query(
    f"WITH {EDGES} SELECT source_topic, target_topic, relationship_type, source_field, round(confidence, 9) AS confidence FROM edges WHERE source_topic = 'orders' AND target_topic = 'customers'"
)
def detect_pair(spark, folder):
    """One pair of topics, by the values of all their records."""
    topics, fields = _fields(spark, folder)
    records = [
        df.select(F.lit(name).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value_json")) for name, df in topics.items() if name in ("orders", "customers")
    ]
    names = fields.select(F.col("topic").alias("name")).distinct()
    edges = relations.detect_pair("orders", "customers", names, fields, records[0].unionByName(records[1]), NOW)
    return edges.select("source_topic", "target_topic", "relationship_type", "source_field", F.round("confidence", 9).alias("confidence"))


CAPACITY, PERIOD = 3, 5_400_000


@query(
    f"""WITH RECURSIVE {EV}, seq AS (SELECT topic, ref, timestamp_ms AS ts, row_number() OVER (PARTITION BY topic ORDER BY timestamp_ms, off) AS rn FROM ev),
    run(topic, rn, ref, level, last, allowed) AS (
      SELECT topic, rn, ref, CAST({(CAPACITY - 1) * PERIOD} AS BIGINT), ts, true FROM seq WHERE rn = 1
      UNION ALL
      SELECT topic, rn, ref, CASE WHEN level >= {PERIOD} THEN level - {PERIOD} ELSE level END, ts, level >= {PERIOD} FROM (
        SELECT s.topic, s.rn, s.ref, s.ts, CAST(least({CAPACITY * PERIOD}, r.level + (s.ts - r.last) * {CAPACITY}) AS BIGINT) AS level
        FROM run r JOIN seq s ON s.topic = r.topic AND s.rn = r.rn + 1))
    SELECT ref AS event_id, allowed, CASE WHEN allowed THEN 0.0 ELSE round(({PERIOD} - level) / {CAPACITY} / 1000.0::DOUBLE, 6) END AS retry_after_sec FROM run"""
)
def token_bucket(spark, folder):
    ev = tables.events(spark, folder).select("topic", "partition", "offset", "timestamp_ms")
    out = throttle.throttle(ev, "topic", ["offset"], CAPACITY, PERIOD)
    return out.select(ids.event_id().alias("event_id"), "allowed", F.round("retry_after_sec", 6).alias("retry_after_sec"))


def _ingested(spark, folder, names, replay: bool):
    """Folder of a run of the ingest stream over the events file, and of another from the start if asked."""
    root = shared_dir(spark, "ingest")
    shape = tables.load(spark, folder, "events").schema
    job = ingest.Job(
        inputs.event_registry(spark, folder), HashingEmbedder(64), ingest.event_table(f"{root}/events", 64),
        ingest.batch_folder(f"{root}/letters"), counters=ingest.batch_folder(f"{root}/counters"),
    )
    for run in ("first", "replay")[: 2 if replay else 1]:
        raw = inputs.raw_events(spark, folder, spark.readStream.schema(shape).parquet(f"{folder}/{names}"))
        ingest.start(raw, job, f"{root}/checkpoint-{run}", {"availableNow": True}).awaitTermination()
    return root


@query(
    f"""WITH {RAW} SELECT ref AS event_id, schema_id, true AS stored, CAST(NULL AS VARCHAR) AS error FROM bodies WHERE {ERROR} IS NULL
    UNION ALL SELECT ref, NULL, false, {ERROR} FROM bodies WHERE {ERROR} IS NOT NULL"""
)
def ingest_stream(spark, folder):
    """The events file as a stream through decode, embed and upsert; replayed once to no effect."""
    root = _ingested(spark, folder, "events*.parquet", True)
    stored = store.read(spark, f"{root}/events").select("event_id", "schema_id", F.lit(True).alias("stored"), F.lit(None).cast("string").alias("error"))
    rejected = spark.read.parquet(f"{root}/letters").select(
        ids.event_id().alias("event_id"), F.lit(None).cast("int").alias("schema_id"), F.lit(False).alias("stored"), "error"
    ).distinct()
    return stored.unionByName(rejected)


@query(
    f"""WITH {RAW} SELECT topic, count(*) FILTER (WHERE {ERROR} IS NULL) AS messages_ingested,
    count(*) FILTER (WHERE {ERROR} IS NOT NULL) AS decode_failures, max(off) + 1 AS next_offset FROM bodies GROUP BY 1"""
)
def ingest_stream_counters(spark, folder):
    """Good and bad records by topic, as the stream counted them."""
    root = _ingested(spark, folder, "events*.parquet", False)
    return ingest.counter_totals(spark.read.parquet(f"{root}/counters"))
