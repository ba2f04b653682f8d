"""Registered queries: catalog tables, descriptions, spend, annotation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import coerce, naming
from tidemark.functions.json_text import struct_json
from tidemark.operators import activity, annotate, budget, models, sampling, topics
from tidemark.plans import catalog, inputs
from tidemark.plans.queries_events import EV, NOW, PART_FIELDS_SQL, part_fields
from tidemark.session import local_rows, shared_dir
from tidemark.sources import registry, tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


EVENT_CATALOG = """cat AS (SELECT name, concat('about ', name) AS description, length(name) / 100.0::DOUBLE AS description_confidence,
  CASE WHEN name = 'click' THEN 'inferred' ELSE 'pending' END AS inference_status
  FROM (SELECT DISTINCT event_type AS name FROM events WHERE event_type < 's' UNION ALL SELECT lower(r_name) FROM region))"""
STATS = """stats AS (SELECT topic, count(*) AS count, min(timestamp_ms) AS oldest_timestamp_ms,
  max(timestamp_ms) AS newest_timestamp_ms FROM ev GROUP BY topic)"""
SAMPLED = """tail AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY off DESC) AS r FROM ev QUALIFY r <= 10),
  samples AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY timestamp_ms DESC, part, off DESC) AS r2 FROM tail QUALIFY r2 <= 10)"""
EVENT_FIELDS = "event_id,props,props.k,user_id,value"


def _event_fields(spark, folder):
    ev = tables.events(spark, folder)
    fields = registry.fields_of(spark, {"": ev.schema["value"].dataType}).drop("topic")
    return ev.select("topic").distinct().crossJoin(F.broadcast(fields))


def _samples(spark, folder):
    ev = tables.events(spark, folder)
    return sampling.recent_samples(ev).withColumn("value_json", struct_json(F.col("value")))


@query(
    f"""WITH {EV}, {SAMPLED}, {EVENT_CATALOG} SELECT name AS topic, description, inference_status,
    CASE WHEN s.topic IS NOT NULL THEN '{EVENT_FIELDS}' END AS fields, s.offsets, a.messages_last_day
    FROM cat LEFT JOIN (SELECT topic, string_agg(off, ',' ORDER BY timestamp_ms DESC, part, off) AS offsets FROM samples GROUP BY topic) s ON s.topic = name
    LEFT JOIN (SELECT topic, count(*) FILTER (WHERE timestamp_ms >= {NOW} - 86400000) AS messages_last_day FROM ev GROUP BY topic) a ON a.topic = name"""
)
def catalog_view(spark, folder):
    view = topics.catalog_view(
        inputs.event_catalog(spark, folder), _event_fields(spark, folder), _samples(spark, folder),
        activity.activity_profile(tables.events(spark, folder), NOW),
    )
    return view.select(
        "topic", "description", "inference_status", F.array_join("fields.name", ",").alias("fields"),
        F.array_join(F.transform("samples.offset", lambda o: o.cast("string")), ",").alias("offsets"), "messages_last_day",
    )


@query(
    f"""WITH {EV}, {STATS}, {EVENT_CATALOG} SELECT coalesce(topic, name) AS topic, coalesce(count, 0) AS count,
    oldest_timestamp_ms, newest_timestamp_ms, description, description_confidence FROM stats FULL JOIN cat ON topic = name"""
)
def list_topics(spark, folder):
    return activity.list_topics(tables.events(spark, folder), inputs.event_catalog(spark, folder))


@query(
    f"""WITH {EV}, {STATS}, {EVENT_CATALOG}, newest AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY timestamp_ms DESC, part, off DESC) AS r FROM ev QUALIFY r <= 3)
    SELECT topic, count, oldest_timestamp_ms, newest_timestamp_ms, description, inference_status, '{EVENT_FIELDS}' AS fields,
    (SELECT string_agg(ref, ',' ORDER BY r) FROM newest WHERE newest.topic = stats.topic) AS samples
    FROM stats LEFT JOIN cat ON name = topic WHERE topic IN ('click', 'view')"""
)
def describe_topic(spark, folder):
    shape = _event_fields(spark, folder)
    note = shape.select("topic", "name", F.lit("m").alias("inferred_meaning"), F.lit(0.5).alias("inferred_confidence")).limit(0)
    declared = topics.schema_overlay(
        shape.select("topic", F.lit("s").alias("subject"), F.lit(1).alias("version"), F.lit(1).alias("schema_id"), "name", "type", "nullable", "doc"),
        shape, note,
    )
    out = topics.describe_topics(
        tables.events(spark, folder), inputs.event_catalog(spark, folder), declared, 3, ["click", "view"]
    )
    return out.select(
        "topic", "count", "oldest_timestamp_ms", "newest_timestamp_ms", "description", "inference_status",
        F.array_join("fields.name", ",").alias("fields"), F.array_join("samples.event_id", ",").alias("samples"),
    )


@query(
    f"""WITH {EV}, s AS (SELECT topic, k, max(timestamp_ms) AS seen FROM ev GROUP BY 1, 2),
    e AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seen DESC, CAST(k AS VARCHAR)) AS r FROM s QUALIFY r <= 5)
    SELECT topic, 'props.k' AS name, 'long' AS type, CASE WHEN topic = 'click' THEN 'a number' END AS inferred_meaning,
    string_agg(k, ',' ORDER BY r) AS example_values FROM e GROUP BY topic"""
)
def explain_field(spark, folder):
    ev = tables.events(spark, folder).withColumn("value_json", struct_json(F.col("value")))
    shape = _event_fields(spark, folder)
    notes = shape.filter((F.col("topic") == "click") & (F.col("name") == "props.k")).select(
        "topic", "name", F.lit("a number").alias("inferred_meaning"), F.lit(0.8).alias("inferred_confidence")
    )
    out = topics.explain_fields(shape, notes, ev, "props.k")
    return out.select("topic", "name", "type", "inferred_meaning", F.array_join("example_values", ",").alias("example_values"))


def _supplier_topics(spark, folder):
    s = tables.load(spark, folder, "supplier")
    number = F.col("s_suppkey")
    stamps = [(number * 1000 + i).alias(c) for i, c in enumerate(catalog.STAMPS.values())]
    old = s.select(
        F.col("s_name").alias("name"), F.lit("old").alias("schema_subject"), number.cast("int").alias("schema_id"),
        F.lit(1).alias("schema_version"), F.lit("fp").alias("schema_fingerprint"), F.lit("{}").alias("raw_schema_json"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("old "), "s_name")).alias("description"),
        F.lit(0.5).alias("description_confidence"), F.lit("inferred").alias("inference_status"), *stamps,
    )
    new = s.filter(F.col("s_nationkey") < 15).select(
        F.when(F.col("s_nationkey") < 5, F.concat(F.lit("new "), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("schema_subject"), (number + 7).cast("int").alias("schema_id"),
        F.lit(2).alias("schema_version"), F.lit(None).cast("string").alias("schema_fingerprint"),
        F.lit(None).cast("string").alias("raw_schema_json"),
        F.when(F.col("s_nationkey") > 10, F.lit("fresh")).alias("description"),
        F.lit(None).cast("double").alias("description_confidence"), F.lit("failed").alias("inference_status"),
        *[F.lit(None).cast("long").alias(c) for c in list(catalog.STAMPS.values())[:3]],
        F.lit(5).cast("long").alias("last_inference_refresh_ms"),
    )
    return old, new


@query(
    """WITH o AS (SELECT s_name AS name, 'old' AS subj, s_suppkey AS id, 1 AS ver, 'fp' AS fp,
      CASE WHEN s_acctbal > 0 THEN concat('old ', s_name) END AS d, 0.5::DOUBLE AS c, 'inferred' AS st, s_suppkey * 1000 AS t1, s_suppkey * 1000 + 3 AS t4 FROM supplier),
    n AS (SELECT CASE WHEN s_nationkey < 5 THEN concat('new ', s_name) ELSE s_name END AS name, s_suppkey + 7 AS id, 2 AS ver,
      CASE WHEN s_nationkey > 10 THEN 'fresh' END AS d, 'failed' AS st, 5 AS t4, true AS isnew FROM supplier WHERE s_nationkey < 15)
    SELECT coalesce(n.name, o.name) AS name, CASE WHEN isnew THEN NULL ELSE subj END AS schema_subject,
    CAST(CASE WHEN isnew THEN n.id ELSE o.id END AS INTEGER) AS schema_id, CAST(CASE WHEN isnew THEN n.ver ELSE o.ver END AS INTEGER) AS schema_version,
    fp AS schema_fingerprint, coalesce(n.d, o.d) AS description, c AS description_confidence,
    CASE WHEN isnew THEN n.st ELSE o.st END AS inference_status, t1 AS last_schema_refresh_ms,
    CAST(coalesce(n.t4, o.t4) AS BIGINT) AS last_inference_refresh_ms FROM o FULL JOIN n ON o.name = n.name"""
)
def merge_topics(spark, folder):
    out = catalog.merge_topics(*_supplier_topics(spark, folder))
    return out.select(
        "name", "schema_subject", "schema_id", "schema_version", "schema_fingerprint", "description",
        "description_confidence", "inference_status", "last_schema_refresh_ms", "last_inference_refresh_ms",
    )


@query(
    """WITH o AS (SELECT p_brand AS topic, concat(p_name, p_partkey) AS name FROM part),
    n AS (SELECT concat('Brand#', s_suppkey % 7) AS topic, s_name AS name FROM supplier WHERE s_acctbal > 0)
    SELECT topic, name FROM o WHERE topic NOT IN (SELECT concat('Brand#', s_suppkey % 7) FROM supplier) UNION ALL SELECT * FROM n"""
)
def replace_by_topic(spark, folder):
    s = tables.load(spark, folder, "supplier").withColumn("topic", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 7).cast("string")))
    old = tables.load(spark, folder, "part").select(
        F.col("p_brand").alias("topic"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name")
    )
    new = s.filter(F.col("s_acctbal") > 0).select("topic", F.col("s_name").alias("name"))
    return catalog.replace_by_key(old, new, "topic", s)


def _order_cache(spark, folder):
    return tables.load(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cache_key"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(
            F.concat(F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit("}"))
        ).alias("payload_json"),
        (F.col("o_orderkey") * 10).alias("created_ms"),
    )


CACHE = """c AS (SELECT concat('c', o_custkey) AS cache_key, arg_max(CASE WHEN o_orderstatus = 'P' THEN 'pending'
  ELSE concat('{"order":', o_orderkey, '}') END, o_orderkey) AS payload_json FROM orders GROUP BY 1)"""


@query(f"WITH {CACHE} SELECT * FROM c WHERE payload_json <> 'pending'")
def cache_latest(spark, folder):
    return models.latest_cache(_order_cache(spark, folder))


@query(
    f"""WITH {CACHE} SELECT concat('c', c_custkey) AS cache_key, payload_json, payload_json IS NOT NULL AS hit
    FROM customer LEFT JOIN (SELECT * FROM c WHERE payload_json <> 'pending') x ON x.cache_key = concat('c', c_custkey)"""
)
def cache_hits(spark, folder):
    asked = tables.load(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cache_key"))
    hits, misses = models.split_cached(asked, _order_cache(spark, folder))
    absent = misses.withColumn("payload_json", F.lit(None).cast("string"))
    return hits.withColumn("hit", F.lit(True)).unionByName(absent.withColumn("hit", F.lit(False)))


COST = """u AS (SELECT conv_id, turn, role AS provider, DATE '2024-01-01' + CAST(conv_id // 50 AS INTEGER) AS day,
  length(text) AS input_tokens, turn + 1 AS output_tokens FROM conversations),
  priced AS (SELECT *, (input_tokens * CASE provider WHEN 'user' THEN 0.25 WHEN 'assistant' THEN 3.0 ELSE 1.0 END::DOUBLE
  + output_tokens * CASE provider WHEN 'user' THEN 1.25 WHEN 'assistant' THEN 15.0 ELSE 4.0 END::DOUBLE) / 1000000.0::DOUBLE AS cost FROM u),
  unit AS (SELECT *, CAST(round(cost * 1000000000) AS BIGINT) AS n FROM priced)"""


def _priced(spark, folder):
    log = inputs.usage_log(spark, folder)
    cost = budget.call_cost(F.col("provider"), F.col("input_tokens"), F.col("output_tokens"), inputs.PRICES, inputs.DEFAULT_PRICE)
    return log.withColumn("cost", cost)


@query(f"WITH {COST} SELECT conv_id, turn, provider, round(cost, 9) AS cost FROM priced")
def usage_cost(spark, folder):
    return _priced(spark, folder).select("conv_id", "turn", "provider", F.round("cost", 9).alias("cost"))


@query(f"WITH {COST} SELECT CAST(day AS DATE) AS day, provider, sum(n) / 1000000000.0::DOUBLE AS spend_usd FROM unit GROUP BY 1, 2")
def spend_by_day(spark, folder):
    return budget.spend_by_day(_priced(spark, folder).withColumnRenamed("cost", "spend_usd"))


@query(
    f"""WITH {COST}, r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY day, provider ORDER BY conv_id, turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM unit)
    SELECT conv_id, turn, provider, before / 1000000000.0::DOUBLE AS spent_before FROM r WHERE before < 20000000"""
)
def budget_gate(spark, folder):
    bucket = F.floor(F.col("conv_id") / 10)
    kept = budget.admit(_priced(spark, folder), ["day", "provider"], ["conv_id", "turn"], bucket, F.col("cost"), 0.02)
    return kept.select("conv_id", "turn", "provider", "spent_before")


STALE_NOW = 915_148_800_000
STALE_TTL = {"schema": 86_400 * 365, "samples": 86_400 * 30, "stats": 0, "inference": 86_400}


@query(
    f"""WITH o AS (SELECT concat('order-', o_orderkey) AS topic, epoch_us(o_orderdate) // 1000 AS ms, o_orderstatus AS st FROM orders)
    SELECT topic, 'schema' AS aspect, {STALE_NOW} - ms >= {86_400_000 * 365} AS stale FROM o
    UNION ALL SELECT topic, 'samples', CASE WHEN st = 'O' THEN true ELSE {STALE_NOW} - ms >= {86_400_000 * 30} END FROM o
    UNION ALL SELECT topic, 'stats', true FROM o
    UNION ALL SELECT topic, 'inference', true FROM o
    UNION ALL SELECT concat('cust-', c_custkey), unnest(['schema', 'samples', 'stats', 'inference']), true FROM customer"""
)
def stale_aspects(spark, folder):
    from tidemark.functions.timeparts import epoch_ms_ntz

    orders = tables.load(spark, folder, "orders")
    stamp = epoch_ms_ntz(F.col("o_orderdate"))
    known = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"),
        stamp.alias("last_schema_refresh_ms"),
        F.when(F.col("o_orderstatus") != "O", stamp).alias("last_sample_refresh_ms"),
        stamp.alias("last_stats_refresh_ms"),
        F.lit(None).cast("long").alias("last_inference_refresh_ms"),
    )
    strangers = tables.load(spark, folder, "customer").select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("topic"))
    names = known.select(F.col("name").alias("topic")).unionByName(strangers)
    return catalog.stale_aspects(known, names, STALE_NOW, STALE_TTL)


CATALOG_FIELDS = """cf AS (SELECT concat('part-', s_suppkey) AS topic, 'name' AS name, 'string' AS type, false AS nullable, 'from catalog' AS doc FROM supplier
  UNION ALL SELECT concat('part-', s_suppkey), 'size', 'int', true, 'how big' FROM supplier
  UNION ALL SELECT concat('supplier-', s_suppkey), 'supplier_id', 'long', false, NULL FROM supplier),
  an AS (SELECT concat('part-', s_suppkey) AS topic, 'size' AS name, concat('size of ', s_suppkey) AS inferred_meaning, 0.9::DOUBLE AS inferred_confidence FROM supplier
  UNION ALL SELECT concat('part-', s_suppkey), 'unknown', 'x', 0.1 FROM supplier
  UNION ALL SELECT concat('supplier-', s_suppkey), 'supplier_id', 'key', 1.0 FROM supplier)"""


def _catalog_fields(spark, folder):
    s = tables.load(spark, folder, "supplier").withColumn("n", F.col("s_suppkey").cast("string"))
    row = lambda prefix, *cells: F.struct(F.concat(F.lit(prefix), "n").alias("topic"), *cells)
    null = F.lit(None).cast("string")

    def field(prefix, name, kind, nullable, doc):
        return row(prefix, F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(nullable).alias("nullable"),
                   null.alias("default_json"), (null if doc is None else F.lit(doc)).alias("doc"))

    def note(prefix, name, meaning, confidence):
        return row(prefix, F.lit(name).alias("name"), meaning.alias("inferred_meaning"), F.lit(confidence).alias("inferred_confidence"))

    fields = s.select(F.inline(F.array(
        field("part-", "name", "string", False, "from catalog"), field("part-", "size", "int", True, "how big"),
        field("supplier-", "supplier_id", "long", False, None),
    )))
    notes = s.select(F.inline(F.array(
        note("part-", "size", F.concat(F.lit("size of "), "n"), 0.9), note("part-", "unknown", F.lit("x"), 0.1),
        note("supplier-", "supplier_id", F.lit("key"), 1.0),
    )))
    return fields, notes


@query(
    f"""WITH d AS ({PART_FIELDS_SQL}), {CATALOG_FIELDS}
    SELECT d.topic, concat(d.topic, '-value') AS subject, d.name, d.type, (d.nullable OR coalesce(cf.nullable, false)) AS nullable,
    coalesce(d.doc, cf.doc) AS doc, CASE WHEN cf.name IS NOT NULL THEN inferred_meaning END AS inferred_meaning,
    CASE WHEN cf.name IS NOT NULL THEN inferred_confidence END AS inferred_confidence
    FROM d LEFT JOIN cf ON cf.topic = d.topic AND cf.name = d.name LEFT JOIN an ON an.topic = d.topic AND an.name = d.name
    UNION ALL SELECT cf.topic, concat(cf.topic, '-value'), cf.name, cf.type, cf.nullable, cf.doc, inferred_meaning, inferred_confidence
    FROM cf LEFT JOIN an ON an.topic = cf.topic AND an.name = cf.name WHERE cf.topic NOT IN (SELECT concat('part-', p_partkey) FROM part)"""
)
def schema_overlay(spark, folder):
    declared = part_fields(spark, folder).select(
        "topic", F.concat("topic", F.lit("-value")).alias("subject"), F.lit(1).alias("version"), F.lit(1).alias("schema_id"),
        "name", "type", "nullable", "doc",
    )
    return topics.schema_overlay(declared, *_catalog_fields(spark, folder)).drop("version", "schema_id")


@query(
    f"""WITH d AS ({PART_FIELDS_SQL}), {CATALOG_FIELDS} SELECT d.topic, d.name, d.type, inferred_meaning, inferred_confidence
    FROM d LEFT JOIN an ON an.topic = d.topic AND an.name = d.name"""
)
def apply_annotations(spark, folder):
    _, notes = _catalog_fields(spark, folder)
    out = annotate.apply_annotations(part_fields(spark, folder), notes)
    return out.select("topic", "name", "type", "inferred_meaning", "inferred_confidence")


@query(
    f"""WITH d AS ({PART_FIELDS_SQL}) SELECT topic, name, name IN ('part_id', 'maker.uuid', 'offers[].supplier_id', 'batch_key') AS is_identifier,
    split_part(type, '<', 1) AS base FROM d"""
)
def identifier_fields(spark, folder):
    f = part_fields(spark, folder)
    return f.select("topic", "name", naming.is_identifier(F.col("name")).alias("is_identifier"), naming.base_type(F.col("type")).alias("base"))


@query(
    f"""WITH {EV}, {SAMPLED}, v AS (SELECT topic, part AS p, off AS o,
      to_json({{'event_id': event_id, 'user_id': user_id, 'value': value, 'props': {{'k': k}}}})::VARCHAR AS v FROM samples)
    SELECT topic, sha256(to_json({{'schema': concat('fp-', topic), 'samples': list({{'p': p, 'o': o, 'v': v}} ORDER BY p, o)}})::VARCHAR) AS cache_key
    FROM v GROUP BY topic"""
)
def sample_fingerprint(spark, folder):
    samples = _samples(spark, folder)
    named = samples.select(F.col("topic").alias("name")).distinct().withColumn("schema_fingerprint", F.concat(F.lit("fp-"), "name"))
    return annotate.sample_fingerprints(samples, named)


def _part_topics(spark, folder):
    """Every part as a topic of its order lines: (topics, fields, samples)."""
    part = tables.load(spark, folder, "part").withColumn("topic", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    catalog_rows = part.select(F.col("topic").alias("name"), F.concat(F.lit("fp-"), "topic").alias("schema_fingerprint"))
    lines = tables.load(spark, folder, "lineitem").select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("topic"),
        (F.col("l_suppkey") % 4).cast("int").alias("partition"),
        ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("offset"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("timestamp_ms"),
        F.lit(None).cast("string").alias("key"),
        "l_orderkey", "l_suppkey",
    )
    value = F.struct(
        F.col("l_orderkey").alias("order_id"), F.lit("ada@example.com").alias("email"),
        F.concat(F.lit("write to ada@example.com about "), F.col("l_suppkey").cast("string")).alias("note"),
    )
    samples = sampling.recent_samples(lines, 10).withColumn("value_json", F.to_json(value)).drop("l_orderkey", "l_suppkey")
    return catalog_rows, part_fields(spark, folder), samples


def _prompt_sql() -> str:
    def entry(path, kind, null, doc):
        parts = [f'{{"name":"{path}","type":"{kind}"']
        if null:
            parts.append(',"nullable":true')
        text = "".join(parts).replace("'", "''")
        text = "'" + text.replace("@brand", "', p_brand, '") + "'"
        tail = "', ',\"doc\":\"', p_name, '\"}'" if doc else "'}'"
        return text + ", " + (tail[3:] if doc else tail)

    rows = sorted((p, k, n, d) for p, k, n, _, d in [(a, b, c, None, e or "") for a, b, c, _, e in inputs.PART_FIELDS])
    schema = ", ',', ".join(entry(*r) for r in rows)
    instruction = annotate.INSTRUCTION.replace("'", "''")
    return f"""WITH l AS (SELECT l_partkey, l_orderkey * 1000 + l_linenumber AS ts, l_suppkey % 4 AS part, (l_orderkey * 16 + l_linenumber) * 1000000 + l_suppkey AS off,
      concat('{{"order_id":', l_orderkey, ',"note":"write to [redacted] about ', l_suppkey, '"}}') AS v FROM lineitem),
    tail AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, part ORDER BY off DESC) AS r FROM l QUALIFY r <= 10),
    top AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY ts DESC, part, off DESC) AS r2 FROM tail QUALIFY r2 <= 5),
    s AS (SELECT l_partkey, string_agg(v, ',' ORDER BY ts DESC, part, off) AS v FROM top GROUP BY 1)
    SELECT topic, sha256(p) AS prompt, length(p) > 16000 AS prompt_truncated FROM (SELECT concat('part-', p_partkey) AS topic, concat('{instruction}', '{{"topic":"part-', p_partkey, '","schema":[', {schema},
    '],"samples":[', coalesce(v, ''), ']}}') AS p FROM part LEFT JOIN s ON l_partkey = p_partkey)"""


@query(_prompt_sql())
def annotation_prompt(spark, folder):
    rows = annotate.prompts(*_part_topics(spark, folder), drop=["email"])
    return rows.select("topic", F.sha2("prompt", 256).alias("prompt"), "prompt_truncated")


def _annotator(prompt: str) -> tuple[str, float]:
    """A deterministic stand-in for a model: describes the topic from the prompt's own JSON."""
    body = json.loads(prompt[prompt.index('{"topic"'):])
    first = body["schema"][0]["name"]
    if body["topic"].endswith("13"):
        return "no idea", 0.001
    answer = {
        "description": f"about {body['topic']}",
        "description_confidence": 1.5,
        "field_annotations": {first: {"meaning": f" the {first} ", "confidence": 0.75}, "size": {"meaning": ""}},
    }
    return "```json\n" + json.dumps(answer) + "\n```", 0.001


@query(
    """SELECT concat('part-', p_partkey) AS topic, CASE WHEN bad THEN 'failed' ELSE 'inferred' END AS inference_status,
    CASE WHEN NOT bad THEN concat('about part-', p_partkey) END AS description, CASE WHEN NOT bad THEN 1.0::DOUBLE END AS description_confidence,
    CASE WHEN NOT bad THEN 'the attrs' END AS meaning FROM (SELECT *, CAST(p_partkey AS VARCHAR) LIKE '%13' AS bad FROM part)"""
)
def annotate_topics(spark, folder):
    out = annotate.annotate(
        *_part_topics(spark, folder), models.Model("local", _annotator), NOW, ceiling=1e9, estimate=0.001, drop=["email"]
    )
    notes = out.annotations.select("topic", F.col("inferred_meaning").alias("meaning"))
    return out.topics.join(notes, "topic", "left")


@query("SELECT count(*) AS asked, least(count(*), 20) AS made, greatest(count(*) - 20, 0) AS refused FROM supplier")
def budget_gate_calls(spark, folder):
    """A ceiling of 1 USD and calls of half their estimate: twenty calls in waves, all others refused."""
    suppliers = tables.load(spark, folder, "supplier")
    asked = suppliers.select(F.col("s_suppkey").cast("string").alias("cache_key"), F.col("s_name").alias("prompt"))
    answers = models.ask(asked, models.Model("local", lambda prompt: ("{}", 0.05), call_usd=0.1), [], ceiling=1.0)
    return answers.agg(
        F.count("*").alias("asked"), F.count_if("admitted").alias("made"), F.count_if(~F.col("admitted")).alias("refused")
    )


@query(
    """SELECT concat('about ', c_nationkey, ' ', c_mktsegment) AS text, count(*) AS customers, 1::BIGINT AS paid FROM customer GROUP BY c_nationkey, c_mktsegment"""
)
def ask_repeated(spark, folder):
    """Customers with one question for each nation and segment: one call for each, under a ceiling that just fits them all in waves."""
    customers = tables.load(spark, folder, "customer")
    about = F.concat_ws(" ", F.col("c_nationkey").cast("string"), "c_mktsegment")
    asked = customers.select("c_custkey", F.md5(about).alias("cache_key"), about.alias("prompt"))
    calls = asked.select("cache_key").distinct().count()
    answers = models.ask(asked, models.Model("local", lambda prompt: (f"about {prompt}", 0.01), call_usd=0.02), ["c_custkey"], ceiling=0.01 * calls + 0.001)
    return answers.groupBy("text").agg(F.count_distinct("c_custkey").alias("customers"), F.count_if(F.col("cost") > 0).alias("paid"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS st, o_totalprice / 200000 AS c FROM orders)
    SELECT o_orderkey AS order_id, st <> 'P' AS readable, CASE WHEN st <> 'P' THEN concat('order ', o_orderkey) END AS description,
    CASE WHEN st <> 'P' THEN least(1.0, greatest(0.0, c)) END AS description_confidence,
    CAST(CASE WHEN st <> 'P' THEN 1 ELSE 0 END AS INTEGER) AS notes, CASE WHEN st <> 'P' THEN 'money' END AS meaning,
    CASE WHEN st <> 'P' THEN 1.0::DOUBLE END AS confidence FROM r"""
)
def parse_annotations(spark, folder):
    orders = tables.load(spark, folder, "orders")
    text = F.concat(
        F.lit('{"description":"order '), F.col("o_orderkey").cast("string"),
        F.lit('","description_confidence":'), (F.col("o_totalprice") / 200000).cast("string"),
        F.lit(',"field_annotations":{"total":{"meaning":" money ","confidence":1.7},"gap":{"meaning":"  "},"num":{"meaning":5},"odd":3}}'),
    )
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(status == "P", F.lit("nope"))
        .otherwise(F.concat(F.lit("Sure. "), text, F.lit(" Anything else?")))
    )
    out = annotate.read_answers(orders.select(F.col("o_orderkey").alias("order_id"), text.alias("text")))
    return out.select(
        "order_id", "readable", "description", "description_confidence", F.size("notes").alias("notes"),
        F.col("notes.total.meaning").alias("meaning"), F.col("notes.total.confidence").alias("confidence"),
    )


@query(
    f"""WITH {EV}, {SAMPLED}, {STATS} SELECT topic, concat(topic, '-value') AS schema_subject, ascii(topic) AS schema_id, 'pending' AS inference_status,
    CAST({NOW} AS BIGINT) AS last_stats_refresh_ms, (SELECT count(*) FILTER (WHERE timestamp_ms >= {NOW} - 86400000) FROM ev WHERE ev.topic = stats.topic) AS messages_last_day,
    (SELECT count(*) FROM samples WHERE samples.topic = stats.topic) AS samples, 'event_id' AS fields,
    (SELECT count(*) - 1 FROM stats) AS edges FROM stats"""
)
def refresh_stale(spark, folder):
    """The whole refresh job over the events table, read back from the catalog it wrote.

    Every topic declares ``event_id``; with a minimum overlap of zero that relates it to all others.
    A second run a millisecond later must find only what has no lifetime left.
    """
    root = shared_dir(spark, "catalog")
    store = catalog.CatalogTables(spark, root)
    sources = catalog.Sources(tables.events(spark, folder), inputs.event_registry(spark, folder))
    names = [r.topic for r in activity.topic_names(sources.events).collect()]
    job = catalog.Refresh(store, sources, catalog.Settings(min_overlap=0.0))
    log = job.once(names, NOW)
    failed = [entry for entry in log if entry[1] != "ok"]
    if failed:
        raise RuntimeError(f"refresh failed: {failed}")
    again = job.once(names, NOW + 1, relationships=False)
    if any(entry[0] != "stats" and entry[0] != "inference" for entry in again):
        raise RuntimeError(f"refreshed what was fresh: {again}")
    kept = store.read("samples").groupBy("topic").agg(F.count(F.lit(1)).alias("samples"))
    listed = store.read("fields").groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("fields"))
    edges = store.read("relationships").groupBy(F.col("source_topic").alias("topic")).agg(F.count(F.lit(1)).alias("edges"))
    rows = store.read("topics").withColumnRenamed("name", "topic")
    for part in (store.read("activity").select("topic", "messages_last_day"), kept, listed, edges):
        rows = rows.join(part, "topic", "left")
    return rows.select(
        "topic", "schema_subject", "schema_id", coerce.status(F.col("inference_status")).alias("inference_status"),
        "last_stats_refresh_ms", "messages_last_day", "samples", "fields", "edges",
    )


class BrokenTopic(Exception):
    """What the stand-in sampler raises for one topic."""


def _sampler_without(topic):
    def sample(events, count):
        if events.filter(F.col("topic") == topic).limit(1).count():
            raise BrokenTopic(f"no partition of {topic}")
        return sampling.recent_samples(events, count)

    return sample


@query(
    f"""WITH {EV}, {SAMPLED}, {STATS} SELECT topic, CASE WHEN topic = 'click' THEN 0 ELSE (SELECT count(*) FROM samples WHERE samples.topic = stats.topic) END AS samples,
    'inferred' AS inference_status, concat('about ', topic) AS description,
    CASE WHEN topic = 'click' THEN 'no partition of click' END AS error FROM stats"""
)
def refresh_with_a_broken_topic(spark, folder):
    """The whole refresh with a model, and a sampler that cannot read one of the topics: that topic is logged, all others are refreshed."""
    catalog_ = catalog.CatalogTables(spark, shared_dir(spark, "catalog"))
    model = models.Model("local", lambda prompt: (json.dumps({"description": "about " + json.loads(prompt[prompt.index('{"topic"'):])["topic"]}), 0.001))
    sources = catalog.Sources(
        tables.events(spark, folder), inputs.event_registry(spark, folder), sampler=_sampler_without("click"), model=model
    )
    names = [r.topic for r in activity.topic_names(sources.events).collect()]
    log = catalog.Refresh(catalog_, sources, catalog.Settings()).once(names, NOW, relationships=False)
    failed = local_rows(spark, [(topic, error) for _, result, _, error, topic in log if result != "ok"], "topic string, error string")
    kept = catalog_.read("samples").groupBy("topic").agg(F.count(F.lit(1)).alias("samples"))
    rows = catalog_.read("topics").select(F.col("name").alias("topic"), "inference_status", "description")
    rows = rows.join(kept, "topic", "left").join(failed, "topic", "left")
    return rows.select("topic", F.coalesce("samples", F.lit(0).cast("long")).alias("samples"), "inference_status", "description", "error")


@query(
    """SELECT concat(p_brand, '/', p_type) AS name, max(p_partkey)::INTEGER AS version, sha256(arg_max(concat('schema of ', p_name), p_partkey)) AS raw_schema
    FROM part GROUP BY p_brand, p_type ORDER BY name"""
)
def topic_names(spark, folder):
    """Every topic of the catalog by name, with the raw schema that its row holds."""
    part = tables.load(spark, folder, "part")
    rows = part.groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("name")).agg(
        F.max("p_partkey").cast("int").alias("schema_version"), F.max_by(F.concat(F.lit("schema of "), "p_name"), "p_partkey").alias("raw_schema_json")
    )
    held = catalog.CatalogTables(spark, shared_dir(spark, "catalog"))
    held.update_topics(rows)
    known = held.read("topics")
    listed = topics.list_names(known)
    return listed.join(known, "name").select("name", F.col("schema_version").alias("version"), F.sha2("raw_schema_json", 256).alias("raw_schema"))
