"""Registered queries: decoding, projection, filters, the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids, json_text, privacy
from tidemark.operators import activity, filters, sampling, search
from tidemark.plans import inputs, store
from tidemark.sources import envelope, registry, tables

NOW = inputs.NOW_MS

#: ``events`` as event coordinates, for the SQL side.
EV = """ev AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, event_id AS off,
  epoch_us(ts) // 1000 AS timestamp_ms, CAST(user_id AS VARCHAR) AS key, event_id, user_id, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props, ts,
  concat(event_type, ':', user_id % 4, ':', event_id) AS ref FROM events)"""
#: ``events`` as raw records, see ``inputs.raw_events``.
RAW = EV + """, raw AS (SELECT *, value >= 5 AS has_body,
  CASE WHEN topic = 'signup' THEN 9999 ELSE ascii(topic) END AS schema_id,
  CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': topic, 'props': props}) AS VARCHAR) AS full_text FROM ev),
  bodies AS (SELECT *, CASE WHEN topic = 'view' THEN left(full_text, 20) ELSE full_text END AS body FROM raw WHERE has_body)"""
ERROR = """CASE WHEN topic = 'signup' THEN 'unknown schema id 9999' WHEN topic = 'view' THEN 'body is not a JSON object' END"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    return envelope.decode(inputs.raw_events(spark, folder), inputs.event_registry(spark, folder))


@query(f"WITH {RAW} SELECT ref AS event_id, timestamp_ms, schema_id, body AS value_json FROM bodies WHERE {ERROR} IS NULL")
def decode_envelope(spark, folder):
    return envelope.good(_decoded(spark, folder)).select(
        ids.event_id().alias("event_id"), "timestamp_ms", "schema_id", "value_json"
    )


@query(f"WITH {EV} SELECT topic, count(*) AS kept, min(off) AS first_offset FROM ev WHERE value >= 5 GROUP BY 1")
def tombstone_drop(spark, folder):
    return _decoded(spark, folder).groupBy("topic").agg(
        F.count(F.lit(1)).alias("kept"), F.min("offset").alias("first_offset")
    )


@query(
    f"WITH {EV} SELECT ref AS event_id, CASE WHEN topic = 'error' THEN 'ff' || lower(hex(key)) ELSE key END AS key FROM ev"
)
def decode_key(spark, folder):
    raw = inputs.raw_events(spark, folder)
    return raw.select(ids.event_id().alias("event_id"), envelope.decode_key(F.col("key")).alias("key"))


@query(
    f"WITH {EV} SELECT ref AS event_id, CAST(event_id AS VARCHAR) AS trace, topic AS kind, '0xfe01' AS bin, 3 AS headers FROM ev"
)
def decode_headers(spark, folder):
    raw = inputs.raw_events(spark, folder).withColumn("h", envelope.decode_headers(F.col("headers")))
    return raw.select(
        ids.event_id().alias("event_id"), F.col("h.trace").alias("trace"), F.col("h.kind").alias("kind"),
        F.col("h.bin").alias("bin"), F.size("h").alias("headers"),
    )


@query(
    f"""WITH {RAW} SELECT topic, part AS "partition", off AS "offset", {ERROR} AS error,
    5 + strlen(body) AS value_bytes, hex(encode(key)) AS raw_key FROM bodies WHERE {ERROR} IS NOT NULL"""
)
def dead_letters(spark, folder):
    bad = envelope.rejects(_decoded(spark, folder))
    return bad.select(
        "topic", "partition", "offset", "error", F.octet_length("raw_value").cast("long").alias("value_bytes"),
        F.hex("raw_key").alias("raw_key"),
    )


@query(
    f"""WITH {RAW} SELECT topic, count(*) FILTER (WHERE {ERROR} IS NULL) AS messages_ingested,
    count(*) FILTER (WHERE {ERROR} IS NOT NULL) AS decode_failures, max(off) + 1 AS next_offset FROM bodies GROUP BY 1"""
)
def ingest_counters(spark, folder):
    return activity.ingest_counters(_decoded(spark, folder))


@query(
    """SELECT concat(p_brand, '/', p_type, '-value') AS subject, concat(p_brand, '/', p_type) AS topic,
    CAST(max(p_partkey) AS INTEGER) AS version, CAST(max(p_partkey) + 1 AS INTEGER) AS schema_id,
    arg_max(p_name, p_partkey) AS doc FROM part GROUP BY p_brand, p_type"""
)
def latest_schema(spark, folder):
    newest = registry.latest(inputs.part_registry(spark, folder))
    doc = F.get_json_object("schema_json", "$.fields[1].doc").alias("doc")
    return newest.select("subject", "topic", "version", "schema_id", doc)


def _sql_text(pieces: list[str], columns: dict[str, str]) -> str:
    quoted = [columns[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces)]
    return "concat(" + ", ".join(quoted) + ")"


PART_COLUMNS = {"name": "p_name", "size": "p_size", "brand": "p_brand"}


@query(
    "SELECT p_partkey AS part_id, sha256("
    + _sql_text(inputs.part_schema_pieces(sort_keys=True), PART_COLUMNS)
    + ") AS fingerprint FROM part"
)
def schema_fingerprint(spark, folder):
    rows = inputs.part_registry(spark, folder)
    return rows.select(
        F.col("version").cast("long").alias("part_id"), json_text.fingerprint(F.col("schema_json")).alias("fingerprint")
    )


def _part_fields_sql() -> str:
    """The expected field rows of every part, as one SELECT per field."""

    def value(text):
        if text is None:
            return "CAST(NULL AS VARCHAR)"
        for mark, column in (("@name", "p_name"), ("@size", "CAST(p_size AS VARCHAR)")):
            if text == mark:
                return column
        if "@brand" in text:
            before, after = text.split("@brand")
            return f"concat('{before}', p_brand, '{after}')"
        return f"'{text}'"

    rows = [
        f"SELECT concat('part-', p_partkey) AS topic, '{path}' AS name, {value(kind)} AS type, {str(null).lower()} AS nullable, "
        f"{value(default)} AS default_json, {value(doc)} AS doc FROM part"
        for path, kind, null, default, doc in inputs.PART_FIELDS
    ]
    return " UNION ALL ".join(rows)


PART_FIELDS_SQL = _part_fields_sql()


def part_fields(spark, folder) -> DataFrame:
    return registry.flatten(inputs.part_registry(spark, folder))


@query(PART_FIELDS_SQL)
def flatten_schema(spark, folder):
    return part_fields(spark, folder)


@query(
    f"""WITH {EV}, tail AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY off DESC) AS r FROM ev QUALIFY r <= 10),
    newest AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY timestamp_ms DESC, part, off DESC) AS r2 FROM tail)
    SELECT topic, part AS "partition", off AS "offset", timestamp_ms, key FROM newest WHERE r2 <= 10"""
)
def recent_samples(spark, folder):
    return sampling.recent_samples(tables.events(spark, folder)).select("topic", "partition", "offset", "timestamp_ms", "key")


@query(
    f"""WITH {EV}, refs AS (
      SELECT topic, arg_max(ref, (value, off)) AS reference FROM ev GROUP BY topic
      UNION ALL SELECT topic, concat(topic, ':-1:', max(off)) FROM ev GROUP BY topic
      UNION ALL SELECT topic, concat(':', min(off), ':1') FROM ev GROUP BY topic)
    SELECT reference, ev.ref IS NOT NULL AS found, ev.value AS value FROM refs LEFT JOIN ev ON ev.ref = refs.reference"""
)
def event_lookup(spark, folder):
    ev = tables.events(spark, folder)
    refs = ev.groupBy("topic").agg(
        F.array(
            F.max_by(ids.event_id(), F.struct("value.value", "offset")),
            F.concat("topic", F.lit(":-1:"), F.max("offset").cast("string")),
            F.concat(F.lit(":"), F.min("offset").cast("string"), F.lit(":1")),
        ).alias("r")
    )
    refs = refs.select(F.explode("r").alias("reference")).withColumn("at", ids.parse_reference(F.col("reference")))
    wanted = refs.select("reference", "at.topic", "at.partition", "at.offset")
    hit = wanted.join(ev.select("topic", "partition", "offset", "value"), ["topic", "partition", "offset"], "left")
    return hit.select("reference", F.col("value").isNotNull().alias("found"), F.col("value.value").alias("value"))


@query(f"""WITH {EV} SELECT ref AS event_id, timestamp_ms FROM ev WHERE topic = 'click' ORDER BY timestamp_ms DESC, part, off DESC LIMIT 20""")
def newest_events(spark, folder):
    rows = sampling.newest_events(tables.events(spark, folder), "click", 20)
    return rows.select(ids.event_id().alias("event_id"), "timestamp_ms")


@query(f"WITH {EV} SELECT topic, count(*) FILTER (WHERE timestamp_ms >= {NOW} - 86400000) AS count FROM ev GROUP BY topic")
def count_since(spark, folder):
    return activity.count_since(tables.events(spark, folder), NOW - activity.DAY_MS)


@query(
    f"""WITH {EV}, batch AS (SELECT * FROM ev WHERE value > 30)
    SELECT ref AS event_id, 'batch' AS copy, value * 2 AS value FROM batch
    UNION ALL SELECT ref, 'target', value FROM ev WHERE value < 60 AND ref NOT IN (SELECT ref FROM batch)"""
)
def upsert_events(spark, folder):
    ev = ids.with_ids(tables.events(spark, folder)).select("point_id", "event_id", F.col("value.value").alias("value"), "timestamp_ms")
    target = ev.filter(F.col("value") < 60).withColumn("copy", F.lit("target"))
    later = ev.filter(F.col("value") > 30).withColumn("copy", F.lit("batch"))
    # The batch holds every row twice: an early form and the one that must win.
    early = later.withColumn("timestamp_ms", F.col("timestamp_ms") - 1)
    batch = early.unionByName(later.withColumn("value", F.col("value") * 2))
    return store.merge_rows(target, batch, "point_id", [F.desc("timestamp_ms")]).select("event_id", "copy", "value")


NUMBER = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"


@query(
    f"""WITH {EV} SELECT ref AS event_id,
    concat('{{"event_id":', event_id, ',"props":{{"k":', k, '}},"user_id":', user_id, ',"value":', {NUMBER}, '}}') AS text FROM ev"""
)
def canonical_text(spark, folder):
    ev = tables.events(spark, folder)
    return ev.select(ids.event_id().alias("event_id"), json_text.canonical_value(F.col("value")).alias("text"))


@query(
    f"""WITH {EV}, h AS (SELECT *, sha256(ref) AS d FROM ev) SELECT ref AS event_id,
    concat(substr(d, 1, 8), '-', substr(d, 9, 4), '-', substr(d, 13, 4), '-', substr(d, 17, 4), '-', substr(d, 21, 12)) AS point_id,
    CAST(ts AS DATE) AS event_date, off // 100000 AS offset_block FROM h"""
)
def event_identity(spark, folder):
    return store.stored_form(tables.events(spark, folder)).select("event_id", "point_id", "event_date", "offset_block")


@query(
    f"""WITH {EV} SELECT ref AS event_id, CAST(to_json({{'event_id': event_id, 'value': value, 'props': {{'n': k}},
    'trail': [{{'value': value}}, {{'value': value + 1}}]}}) AS VARCHAR) AS value_json FROM ev"""
)
def redact_fields(spark, folder):
    ev = tables.events(spark, folder)
    step = lambda by: F.struct("value.user_id", (F.col("value.value") + by).alias("value"))
    value = F.struct(
        "value.event_id", "value.user_id", "value.value",
        F.struct("value.props.k", F.col("value.props.k").alias("n")).alias("props"),
        F.array(step(0), step(1)).alias("trail"),
    )
    ev = ev.withColumn("value", value)
    clean = privacy.redact(F.col("value"), ev.schema["value"].dataType, ["user_id", "k"])
    return ev.select(ids.event_id().alias("event_id"), F.to_json(clean).alias("value_json"))


def _mask_sql(column: str) -> str:
    for pattern in privacy.DEFAULT_PATTERNS:
        column = f"regexp_replace({column}, '{pattern}', '[redacted]', 'gi')"
    return column


@query(f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def mask_pii(spark, folder):
    # ASCII classes, because that is what the SQL side's regular expressions know.
    docs = tables.load(spark, folder, "documents")
    return docs.select("doc_id", privacy.mask_text(F.col("text"), unicode=False).alias("text"))


CAPPED = """j AS (SELECT *, CAST(to_json({'doc_id': doc_id, 'text': text, 'source': source}) AS VARCHAR) AS v FROM documents)"""


@query(
    f"""WITH {CAPPED} SELECT concat(lang, ':', doc_id % 4, ':', doc_id) AS event_id, source AS key,
    CASE WHEN length(v) > 1024 THEN CAST(to_json({{'_truncated': true, '_size_bytes': length(v), '_preview': left(v, 896)}}) AS VARCHAR) ELSE v END AS value_json,
    length(v) > 1024 AS value_truncated FROM j"""
)
def cap_value(spark, folder):
    docs = tables.documents(spark, folder).withColumn("value", F.struct("value.doc_id", "value.text", "value.source"))
    return search.results(docs, 1024).select("event_id", "key", "value_json", "value_truncated")


@query(f"WITH {EV} SELECT k, count(*) AS events FROM ev GROUP BY k")
def nested_value(spark, folder):
    ev = tables.events(spark, folder).withColumn("value_json", json_text.struct_json(F.col("value")))
    leaf = json_text.scalar_at(F.col("value_json"), "props.k").cast("long")
    return ev.groupBy(leaf.alias("k")).agg(F.count(F.lit(1)).alias("events"))


def _found(df: DataFrame) -> DataFrame:
    return df.select(ids.event_id().alias("event_id"), F.col("value.value").alias("value"))


@query(f"WITH {EV} SELECT ref AS event_id, value FROM ev WHERE k = 42")
def filter_eq(spark, folder):
    """On JSON text: the clause must not match the text '42'."""
    ev = tables.events(spark, folder).withColumn("value_json", json_text.struct_json(F.col("value")))
    flat = ev.select("topic", "partition", "offset", "value_json", F.col("value.value").alias("v"))
    hit = filters.where(flat, clauses=[{"field": "props.k", "eq": 42}])
    none = filters.where(flat, clauses=[{"field": "props.k", "eq": "42"}])
    return hit.unionByName(none).select(ids.event_id().alias("event_id"), F.col("v").alias("value"))


@query(f"WITH {EV} SELECT ref AS event_id, value FROM ev WHERE user_id IN (3, 5, 8, 13)")
def filter_in(spark, folder):
    return _found(filters.where(tables.events(spark, folder), clauses=[{"field": "user_id", "in_values": [3, 5, 8, 13]}]))


@query(f"WITH {EV} SELECT ref AS event_id, value FROM ev WHERE value BETWEEN 100 AND 200.5")
def filter_range(spark, folder):
    return _found(filters.where(tables.events(spark, folder), clauses=[{"field": "value.value", "gte": 100, "lte": 200.5}]))


@query(
    f"""WITH {EV} SELECT ref AS event_id, value FROM ev
    WHERE topic = 'purchase' AND timestamp_ms >= {NOW} - 3000000000 AND value >= 10 AND k IN (1, 2, 3, 4, 5, 6, 7, 8, 9)"""
)
def filter_combined(spark, folder):
    """The look-back is longer than a week, and not cut."""
    clauses = [{"field": "value.value", "gte": 10}, {"field": "props.k", "in_values": list(range(1, 10))}]
    return _found(filters.where(tables.events(spark, folder), "purchase", 50_000, clauses, now_ms=NOW))


@query("SELECT o_orderkey AS order_key FROM orders WHERE o_orderkey IN (1, 2, 32, 4000)")
def filter_large_integers(spark, folder):
    """Neighbours beyond 2^53, which doubles cannot tell apart."""
    big = 2**53
    orders = tables.load(spark, folder, "orders").select(
        "o_orderkey", F.lit("orders").alias("topic"), F.to_json(F.struct((F.col("o_orderkey") + big).alias("n"))).alias("value_json")
    )
    hit = filters.where(orders, clauses=[{"field": "n", "in_values": [big + k for k in (1, 2, 32, 4000)]}])
    return hit.select(F.col("o_orderkey").alias("order_key"))


@query(f"WITH {EV} SELECT topic, count(*) AS events FROM ev WHERE topic IN ('click', 'view') GROUP BY topic")
def topic_allowlist(spark, folder):
    ev = tables.events(spark, folder)
    allowed = filters.where(ev, allowlist=["click", "view", "nowhere"])
    denied = filters.where(ev, topic="error", allowlist=["click", "view"])
    return allowed.unionByName(denied).groupBy("topic").agg(F.count(F.lit(1)).alias("events"))


@query(f"""WITH {EV} SELECT topic, part AS "partition", max(off) + 1 AS next_offset FROM ev GROUP BY 1, 2""")
def next_offsets(spark, folder):
    return activity.next_offsets(tables.events(spark, folder))


@query(
    f"""WITH {EV} SELECT topic, count(*) AS count, min(timestamp_ms) AS oldest_timestamp_ms,
    max(timestamp_ms) AS newest_timestamp_ms FROM ev GROUP BY topic"""
)
def topic_stats(spark, folder):
    return activity.topic_stats(tables.events(spark, folder))


@query(
    f"""WITH {EV}, a AS (SELECT topic, count(*) FILTER (WHERE timestamp_ms >= {NOW} - 3600000) AS messages_last_hour,
    count(*) FILTER (WHERE timestamp_ms >= {NOW} - 86400000) AS messages_last_day,
    string_agg(DISTINCT CAST(ascii(topic) + part AS VARCHAR), ',' ORDER BY CAST(ascii(topic) + part AS VARCHAR)) AS observed_schema_versions,
    max(timestamp_ms) AS last_observed_ts_ms FROM ev GROUP BY topic)
    SELECT *, messages_last_hour / 60.0::DOUBLE AS rate_per_minute_last_hour FROM a"""
)
def activity_profile(spark, folder):
    ev = tables.events(spark, folder).withColumn("schema_id", F.ascii("topic") + F.col("partition"))
    out = activity.activity_profile(ev, NOW)
    texts = F.array_sort(F.transform("observed_schema_versions", lambda v: v.cast("string")))
    return out.withColumn("observed_schema_versions", F.array_join(texts, ","))


@query(f"WITH {EV} SELECT topic, timestamp_ms - timestamp_ms % 10000 AS slot_ms, count(*) AS events FROM ev GROUP BY 1, 2")
def throughput_10s(spark, folder):
    return activity.throughput(tables.events(spark, folder))


@query(
    f"""WITH {EV}, m AS (SELECT topic, timestamp_ms - timestamp_ms % 60000 AS s, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT topic, s + 60000 AS until_ms,
    CAST(sum(n) OVER (PARTITION BY topic ORDER BY s RANGE BETWEEN 3540000 PRECEDING AND CURRENT ROW) AS BIGINT) AS messages_last_hour,
    CAST(sum(n) OVER (PARTITION BY topic ORDER BY s RANGE BETWEEN 86340000 PRECEDING AND CURRENT ROW) AS BIGINT) AS messages_last_day FROM m"""
)
def rolling_activity(spark, folder):
    return activity.rolling_activity(tables.events(spark, folder))


@query(
    f"""WITH {EV}, s AS (SELECT topic, CAST(k AS VARCHAR) AS example, max(timestamp_ms) AS seen FROM ev GROUP BY 1, 2)
    SELECT topic, example, CAST(row_number() OVER (PARTITION BY topic ORDER BY seen DESC, example) AS INTEGER) AS example_rank
    FROM s QUALIFY example_rank <= 5"""
)
def example_values(spark, folder):
    return sampling.example_values(tables.events(spark, folder), F.col("value.props.k"), ["topic"])


@query(
    """SELECT o_orderpriority AS aspect, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS result, count(*) AS runs,
    max(o_totalprice / 1000) AS max_seconds, count(*) FILTER (WHERE o_totalprice / 1000 <= 50) AS le_0,
    count(*) FILTER (WHERE o_totalprice / 1000 <= 150) AS le_1, count(*) FILTER (WHERE o_totalprice / 1000 <= 300) AS le_2
    FROM orders GROUP BY 1, 2"""
)
def refresh_outcomes(spark, folder):
    runs = tables.load(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("aspect"),
        F.when(F.col("o_orderstatus") == "F", F.lit("error")).otherwise(F.lit("ok")).alias("result"),
        (F.col("o_totalprice") / 1000).alias("seconds"),
    )
    return activity.refresh_outcomes(runs, (50, 150, 300))
