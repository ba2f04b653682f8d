"""Registered queries: embedding and similarity search."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.json_text import canonical_value
from tidemark.operators import embedding, search, topics
from tidemark.operators.embedding import HashingEmbedder, embed_column
from tidemark.plans import inputs, store, vector_index
from tidemark.plans.queries_events import EV, NUMBER
from tidemark.session import shared_dir
from tidemark.sources import tables

QUERIES: dict = {}
ORACLES: dict = {}
DIM = 64
COSINES = [math.cos(i) for i in range(DIM)]
SINES = [math.sin(i + 1) for i in range(DIM)]

#: ``embeddings`` as stored events, for the SQL side.
VEC = """vec AS (SELECT concat('label', label, ':', vec_id % 4, ':', vec_id) AS ref, vec_id, label,
  CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
Q_COS = f"list_transform(range({DIM}), lambda i: cos(i))"
Q_SIN = f"list_transform(range({DIM}), lambda i: sin(i + 1))"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def embedded(name: str, source: str) -> str:
    """CTEs that hash-embed ``source`` (id, text) into ``name`` (id, slot, w)."""
    return f"""{name}_h AS (SELECT id, md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM ({source})),
  {name}_c AS (SELECT id, CAST(concat('0x', substr(h, 1, 4)) AS INTEGER) % {DIM} AS slot,
    sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END) AS c FROM {name}_h GROUP BY 1, 2),
  {name} AS (SELECT id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}_c WHERE c <> 0)"""


def _scores(df):
    return df.select("event_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {VEC}, s AS (SELECT ref AS event_id, round(list_cosine_similarity(e, {Q_COS}), 9) AS s FROM vec)
    SELECT event_id, round(s, 6) AS score FROM s ORDER BY s DESC, event_id LIMIT 20"""
)
def search_topk(spark, folder):
    return _scores(search.search(tables.vectors(spark, folder), COSINES, 20))


@query(
    f"""WITH {VEC}, s AS (SELECT ref AS event_id, round(list_cosine_similarity(e, {Q_COS}), 9) AS s FROM vec
      WHERE label IN (1, 2, 3) AND 1704067200000 + vec_id * 60000 >= 1704067200000)
    SELECT event_id, round(s, 6) AS score FROM s WHERE s >= 0.05 ORDER BY s DESC, event_id LIMIT 500"""
)
def search_threshold(spark, folder):
    found = search.search(
        tables.vectors(spark, folder), COSINES, 500, threshold=0.05, allowlist=["label1", "label2", "label3"],
        minutes=10_080, now_ms=1_704_067_200_000 + 60_000 * 10_080,
    )
    return _scores(found)


@query(
    f"""WITH {VEC}, s AS (SELECT ref AS event_id, round(list_cosine_similarity(e, {Q_COS}), 9) AS s FROM vec)
    SELECT event_id, round(s, 6) AS score FROM s ORDER BY s DESC, event_id LIMIT 400"""
)
def search_many(spark, folder):
    """More hits than the cap of the engine this one follows."""
    return _scores(search.search(tables.vectors(spark, folder), COSINES, 400))


def centroids(spark, folder):
    """The mean vector per label: as many queries as labels, from the whole table."""
    cells = tables.load(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return listed.select(F.col("label").alias("query_id"), F.transform("v", lambda c: c["m"]).alias("vector"))


CENTROIDS = f"""cells AS (SELECT label, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM vec),
  means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2),
  q AS (SELECT label AS query_id, list(m ORDER BY pos) AS v FROM means GROUP BY 1)"""


@query(
    f"""WITH {VEC}, {CENTROIDS}, s AS (SELECT query_id, ref AS event_id, round(list_cosine_similarity(e, v), 9) AS s FROM vec, q)
    SELECT query_id, event_id, round(s, 6) AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, event_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
)
def search_batch(spark, folder):
    found = search.search_batch(tables.vectors(spark, folder), centroids(spark, folder), 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH RECURSIVE {VEC}, s AS (SELECT ref, e, round(list_cosine_similarity(e, {Q_COS}), 9) AS s FROM vec),
    pool AS (SELECT * FROM s ORDER BY s DESC, ref LIMIT 30),
    sim AS (SELECT a.ref AS a, b.ref AS b, list_cosine_similarity(a.e, b.e) AS c FROM pool a, pool b),
    pick(n, chosen) AS (
      SELECT 0, CAST([] AS VARCHAR[])
      UNION ALL
      SELECT n + 1, list_append(chosen, (SELECT arg_max(p.ref, 0.7 * p.s - 0.3 * coalesce(
          (SELECT max(c) FROM sim WHERE sim.a = p.ref AND list_contains(chosen, sim.b)), 0)) FROM pool p WHERE NOT list_contains(chosen, p.ref)))
      FROM pick WHERE n < 10)
    SELECT unnest(chosen) AS event_id, generate_subscripts(chosen, 1)::INTEGER AS rank FROM pick WHERE n = 10"""
)
def search_diverse(spark, folder):
    return search.search(tables.vectors(spark, folder), COSINES, 10, diverse=True).select("event_id", "rank")


@query(
    f"""WITH {VEC}, s AS (SELECT ref AS event_id, round(list_cosine_similarity(e, {Q_SIN}), 9) AS s FROM vec)
    SELECT event_id, round(s, 6) AS score FROM s ORDER BY s DESC, event_id LIMIT 10"""
)
def ann_search(spark, folder):
    """From the cells of a stored table, pruned by pivots and exact all the same. A second write of some events moves their entries."""
    path = shared_dir(spark, "indexed-events")
    rows = store.stored_form(tables.vectors(spark, folder))
    even = F.col("offset") % 2 == 0
    store.upsert(rows.filter(even), path, DIM)
    vector_index.create(spark, path)
    again = rows.filter(~even | (F.col("offset") % 6 == 0))
    store.upsert(again, path, DIM)
    return _scores(vector_index.search_table(spark, path, SINES, 10))


@query(
    f"""WITH {VEC}, r AS (SELECT ref AS rr, e AS re FROM vec ORDER BY vec_id LIMIT 1),
    s AS (SELECT ref AS event_id, round(list_cosine_similarity(e, re), 9) AS s FROM vec, r WHERE ref <> rr)
    SELECT event_id, round(s, 6) AS score FROM s ORDER BY s DESC, event_id LIMIT 15"""
)
def similar_events(spark, folder):
    vectors = tables.vectors(spark, folder)
    reference = vectors.agg(F.min_by(ids.event_id(), "offset")).first()[0]
    return _scores(search.similar(vectors, reference, 15))


@query(
    f"""WITH {VEC}, r AS (SELECT label, arg_max(ref, vec_id) AS rr, arg_max(e, vec_id) AS re FROM vec GROUP BY label),
    s AS (SELECT rr AS query_id, ref AS event_id, round(list_cosine_similarity(e, re), 9) AS s FROM vec, r WHERE ref <> rr)
    SELECT query_id, event_id, round(s, 6) AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, event_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""
)
def similar_batch(spark, folder):
    vectors = tables.vectors(spark, folder)
    last = vectors.groupBy("topic").agg(F.max_by(ids.event_id(), "offset").alias("event_id"))
    return search.similar_batch(vectors, last, 5).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {EV}, {embedded("d", f'''SELECT ref AS id,
      concat('event_id ', event_id, ' props k ', k, ' user_id ', user_id, ' value ', {NUMBER}) AS text FROM ev
      WHERE value >= 5 AND timestamp_ms >= {inputs.NOW_MS} - 10080 * 60000''')},
    {embedded("q", "SELECT 'q' AS id, 'purchase value 42' AS text")},
    s AS (SELECT d.id AS event_id, round(sum(d.w * q.w), 9) AS s FROM d JOIN q ON d.slot = q.slot GROUP BY 1)
    SELECT event_id, round(s, 6) AS score FROM s WHERE s >= 0 ORDER BY s DESC, event_id LIMIT 20"""
)
def search_text(spark, folder):
    """From the table to the answer: text, vector, filters, threshold, top-k."""
    embedder = HashingEmbedder(DIM)
    events = tables.events(spark, folder)
    vectors = events.withColumn("embedding", embed_column(embedder, canonical_value(F.col("value"))))
    found = search.search_text(
        vectors, "purchase value 42", embedder, limit=20, minutes=10_080, now_ms=inputs.NOW_MS, threshold=0.0,
        clauses=[{"field": "value.value", "gte": 5}],
    )
    return _scores(found)


@query(f"WITH {embedded('d', 'SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, slot, round(w, 6) AS weight FROM d")
def hash_embed(spark, folder):
    docs = tables.load(spark, folder, "documents")
    cells = docs.select("doc_id", F.posexplode(embed_column(HashingEmbedder(DIM), F.col("text"))).alias("slot", "w"))
    return cells.filter(F.col("w") != 0).select("doc_id", "slot", F.round("w", 6).alias("weight"))


@query(
    f"""WITH {embedded("d", "SELECT doc_id AS id, text FROM documents")},
    v AS (SELECT id, sum(w * (slot + 1)) AS checksum FROM d GROUP BY id)
    SELECT doc_id, round(checksum, 6) + 0.0 AS checksum FROM documents JOIN v ON id = doc_id"""
)
def embed_distinct(spark, folder):
    """Each different text once; what other languages' documents say twice comes from the cache."""
    docs = tables.load(spark, folder, "documents").select("doc_id", "lang", "text")
    _, cache = embedding.embed_distinct(docs.filter(F.col("lang") != "en"), HashingEmbedder(DIM))
    out, _ = embedding.embed_distinct(docs, HashingEmbedder(DIM), cache)
    weighted = F.aggregate(
        F.zip_with("embedding", F.sequence(F.lit(1), F.lit(DIM)), lambda w, i: w * i), F.lit(0.0), lambda a, x: a + x
    )
    return out.select("doc_id", (F.round(weighted, 6) + F.lit(0.0)).alias("checksum"))


@query(
    """WITH n AS (SELECT lang, count(*) AS texts FROM documents GROUP BY lang),
    f AS (SELECT text, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text),
    m AS (SELECT lang, count(*) AS misses FROM f GROUP BY lang)
    SELECT lang, texts, coalesce(misses, 0) AS misses, texts - coalesce(misses, 0) AS hits FROM n LEFT JOIN m USING (lang)"""
)
def embed_reuse(spark, folder):
    return embedding.reuse_counts(tables.load(spark, folder, "documents"), ["lang"], ["doc_id"])


@query(
    f"""WITH t AS (SELECT concat('part-', p_partkey) AS name, CASE WHEN p_size > 10 THEN concat(p_type, ' ', p_name) END AS description,
      CASE WHEN p_size > 10 THEN p_size / 100.0::DOUBLE END AS description_confidence FROM part),
    x AS (SELECT *, coalesce(description, concat('Kafka topic ''', name,
      ''' with fields: attrs, batch_key, code, grade, made_at, maker, maker.tags, maker.uuid.')) AS purpose FROM t),
    {embedded("d", "SELECT name AS id, purpose AS text FROM x")},
    {embedded("q", "SELECT 'q' AS id, 'large blue widget made for a promotion' AS text")},
    s AS (SELECT d.id AS name, round(sum(d.w * q.w), 9) AS s FROM d JOIN q ON d.slot = q.slot GROUP BY 1)
    SELECT name, round(coalesce(s, 0), 6) AS score, description, description_confidence,
    CASE WHEN description IS NULL THEN 'synthesized' ELSE 'inferred' END AS description_source
    FROM x LEFT JOIN s USING (name) ORDER BY coalesce(s, 0) DESC, name LIMIT 25"""
)
def topics_by_purpose(spark, folder):
    from tidemark.plans.queries_events import part_fields

    part = tables.load(spark, folder, "part")
    big = F.col("p_size") > 10
    catalog = part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(big, F.concat("p_type", F.lit(" "), "p_name")).alias("description"),
        F.when(big, F.col("p_size") / 100.0).alias("description_confidence"),
    )
    found = topics.topics_by_purpose(
        catalog, part_fields(spark, folder), "large blue widget made for a promotion", HashingEmbedder(DIM), 25
    )
    return found.withColumn("score", F.round("score", 6))
