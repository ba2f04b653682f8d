"""The topic catalog: tables, merge rules, and the refresh job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import privacy
from tidemark.operators import activity, annotate, models, relations, sampling
from tidemark.plans import store
from tidemark.sources import registry as registry_source
from tidemark.session import local_rows

ASPECTS = ("schema", "samples", "stats", "inference")
STAMPS = {
    "schema": "last_schema_refresh_ms",
    "samples": "last_sample_refresh_ms",
    "stats": "last_stats_refresh_ms",
    "inference": "last_inference_refresh_ms",
}
#: Topics that may fail one by one before an aspect counts as broken.
MAX_FAILING = 16
#: Columns a new topic row always overwrites, also with null; all others keep the old value then.
OVERWRITTEN = ("schema_subject", "schema_id", "schema_version", "inference_status")

TABLES = {
    "topics": schemas.TOPICS,
    "fields": schemas.FIELDS,
    "annotations": schemas.ANNOTATIONS,
    "samples": schemas.SAMPLES,
    "activity": schemas.ACTIVITY,
    "relationships": schemas.RELATIONSHIPS,
    "annotation_cache": schemas.ANNOTATION_CACHE,
    "spend": schemas.SPEND,
    "runs": schemas.RUN_LOG,
}


@dataclass(frozen=True)
class Settings:
    """Refresh periods in seconds and the knobs of the refresh job."""

    # The default periods, counts and bounds that users of the catalog know.
    schema_sec: int = 300
    samples_sec: int = 900
    stats_sec: int = 60
    inference_sec: int = 3600
    sample_count: int = 10
    retain_samples: bool = True
    daily_ceiling_usd: float = 1.0
    #: None: the model's own figure.
    call_estimate_usd: float | None = None
    drop_fields: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    min_overlap: float = relations.MIN_OVERLAP
    score_threshold: float = relations.SCORE_THRESHOLD

    def ttl(self) -> dict[str, int]:
        return {"schema": self.schema_sec, "samples": self.samples_sec, "stats": self.stats_sec, "inference": self.inference_sec}


# -- merge rules -----------------------------------------------------------------------------------


def merge_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Topic rows after an upsert: a full join on the name with one rule per column."""
    columns = [c for c in old.columns if c != "name"]
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), "name", "full")

    def pick(c: str) -> Column:
        if c in OVERWRITTEN:
            return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)

    return joined.select("name", *[pick(c) for c in columns])


def replace_by_key(old: DataFrame, new: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """Rows of every replaced key come from ``new`` alone; other keys stay.

    ``replaced`` lists the keys when some of them are to end up empty.
    """
    keys = (new if replaced is None else replaced).select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new)


def stale_aspects(topics: DataFrame, names: DataFrame, now_ms: int, ttl: dict[str, int]) -> DataFrame:
    """(topic, aspect, stale): never refreshed, no lifetime, or older than it; unknown topics all."""
    joined = names.select(F.col("topic")).distinct().join(
        topics.select(F.col("name").alias("topic"), *STAMPS.values()), "topic", "left"
    )

    def cell(aspect: str) -> Column:
        last, seconds = F.col(STAMPS[aspect]), ttl[aspect]
        age = F.lit(True) if seconds <= 0 else (now_ms - last >= seconds * 1000)
        return F.struct(F.lit(aspect).alias("aspect"), F.coalesce(age, F.lit(True)).alias("stale"))

    return joined.select("topic", F.inline(F.array(*[cell(a) for a in ASPECTS])))


# -- tables ----------------------------------------------------------------------------------------


#: Tables whose rows are replaced key by key; of the others, ``topics`` is folded by column and the rest only grows.
REPLACED = {"fields": "topic", "annotations": "topic", "samples": "topic", "activity": "topic", "relationships": "source_topic"}


class CatalogTables:
    """The catalog as plain Parquet that is only ever appended to, folded when it is read. One writer at a time.

    * Cache, spend and run log: appended rows, read as they are.
    * Replaced tables: the new rows of some keys with a version, and after them one mark per key with the same version. A reader
      takes every key's rows of its latest mark. Rows of a write that died before its marks are never seen.
    * Topics: each write has the columns it changes; a reader takes the last known value of every column.

    :func:`compact` copies what a reader sees into a fresh folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _scan(self, folder: str, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(folder) if store.exists(self.spark, folder) else None

    def _rows(self, table: str) -> DataFrame | None:
        versioned = table == "topics" or table in REPLACED
        return self._scan(f"{self.root}/{table}", TABLES[table] + (", version BIGINT" if versioned else ""))

    def _marks(self, table: str) -> DataFrame | None:
        return self._scan(f"{self.root}/{table}_marks", f"{REPLACED[table]} STRING, version BIGINT")

    def read(self, table: str) -> DataFrame:
        rows, columns = self._rows(table), schemas._schema(TABLES[table]).fieldNames()
        if rows is None or (table in REPLACED and self._marks(table) is None):
            return local_rows(self.spark, [], TABLES[table])
        if table == "topics":
            return fold_topics(rows).select(columns)
        if table not in REPLACED:
            return rows
        key = REPLACED[table]
        latest = self._marks(table).groupBy(key).agg(F.max("version").alias("version"))
        return rows.join(latest, [key, "version"], "left_semi").select(columns)

    def _version(self, *written: DataFrame | None) -> int:
        """One more than any version there is, whether its write was finished or not; one number from each part."""
        return 1 + max([r.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] for r in written if r is not None], default=0)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        wanted = schemas._schema(TABLES[table])
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table that only grows; nothing of it is read."""
        if table == "topics" or table in REPLACED:
            raise ValueError(f"{table} is not a table that only grows")
        self._shaped(table, rows).write.mode("append").parquet(f"{self.root}/{table}")

    def replace(self, table: str, rows: DataFrame, keys: DataFrame) -> None:
        """``rows`` take the place of all rows of ``keys`` (one column), also where there are none."""
        version = self._version(self._rows(table), self._marks(table))
        self._shaped(table, rows).withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.root}/{table}")
        marks = keys.toDF(REPLACED[table]).distinct().withColumn("version", F.lit(version).cast("long"))
        marks.write.mode("append").parquet(f"{self.root}/{table}_marks")

    def update_topics(self, rows: DataFrame) -> None:
        """New values of some columns of some topics; null or missing ones keep what is known."""
        version = self._version(self._rows("topics"))
        self._shaped("topics", rows).withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.root}/topics")


def fold_topics(rows: DataFrame) -> DataFrame:
    """The last known value of every column by topic, over rows with a ``version``."""
    columns = [c for c in rows.columns if c not in ("name", "version")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in columns]
    folded = rows.groupBy("name").agg(*last)
    return folded.withColumn("inference_status", F.coalesce("inference_status", F.lit("pending")))


def compact(tables: CatalogTables, root: str) -> CatalogTables:
    """The same catalog with one write per table, in a fresh folder; readers and the writer change over to it."""
    fresh = CatalogTables(tables.spark, root)
    for table in TABLES:
        rows = tables.read(table)
        if table == "topics":
            fresh.update_topics(rows)
        elif table in REPLACED:
            fresh.replace(table, rows, rows.select(REPLACED[table]))
        else:
            fresh.append(table, rows)
    return fresh


# -- refresh ---------------------------------------------------------------------------------------


@dataclass
class Sources:
    """What a refresh reads. Any of the optional ones may be missing."""

    events: DataFrame
    registry: DataFrame | None = None
    sampler: Callable[[DataFrame, int], DataFrame] | None = None
    model: models.Model | None = None
    scorer: models.Model | None = None


@dataclass
class Refresh:
    """One pass over the catalog. Each aspect is one job over all its stale topics at once."""

    tables: CatalogTables
    sources: Sources
    settings: Settings = field(default_factory=Settings)

    def once(self, names: Iterable[str], now_ms: int, force: bool = False, relationships: bool = True) -> list[tuple]:
        """Refresh what is stale, then the relationships; returns the run log rows.

        An aspect that fails is tried again for halves of its topics, until the topics that fail are alone; these are
        logged and the others go on.
        """
        spark = self.tables.spark
        listed = sorted(set(names))
        wanted = local_rows(spark, [(n,) for n in listed], "topic string")
        due = stale_aspects(self.tables.read("topics"), wanted, now_ms, self.settings.ttl())
        # (topic, aspect) names of the catalog, never event data.
        stale: dict[str, list[str]] = {a: [] for a in ASPECTS}
        for row in due.filter(F.lit(force) | F.col("stale")).select("topic", "aspect").collect():
            stale[row.aspect].append(row.topic)
        steps = [(a, getattr(self, f"_{a}")) for a in ASPECTS if stale[a]]
        log = [row for aspect, step in steps for row in self._tracked(aspect, step, stale[aspect], now_ms)]
        if relationships:
            log.append(self._tried("relationships", self._relationships, listed, now_ms))
        self.tables.append("runs", local_rows(spark, log, schemas.RUN_LOG))
        return log

    def _tried(self, aspect: str, step, names: list[str], now_ms: int) -> tuple:
        """(aspect, result, seconds, error, topic) of one attempt; the topic only where it is the only one."""
        started, result, error = time.perf_counter(), "ok", None
        try:
            step(names, now_ms)
        except Exception as exc:
            result, error = "error", str(exc)[:500]
        return aspect, result, time.perf_counter() - started, error, names[0] if len(names) == 1 and error else None

    def _tracked(self, aspect: str, step, names: list[str], now_ms: int) -> list[tuple]:
        """Log rows of an aspect: of the whole if it passes, else of what passed together and of every topic that fails.

        All topics go through one job; only a failure costs more of them, two for each halving. After ``MAX_FAILING`` failed topics the
        fault is taken for one of the source: what is left is logged as not tried.
        """
        whole = self._tried(aspect, step, names, now_ms)
        if whole[1] == "ok" or len(names) == 1:
            return [whole]
        failed, seconds, passed, open_ = [], whole[2], 0, [names[len(names) // 2 :], names[: len(names) // 2]]
        while open_:
            part = open_.pop()
            if len(failed) >= MAX_FAILING:
                failed += [(aspect, "error", 0.0, "not tried after too many failures", n) for n in part]
                continue
            row = self._tried(aspect, step, part, now_ms)
            seconds += row[2]
            if row[1] == "ok":
                passed += len(part)
            elif len(part) == 1:
                failed.append(row)
            else:
                open_ += [part[len(part) // 2 :], part[: len(part) // 2]]
        return [*([(aspect, "ok", seconds, None, None)] if passed else []), *failed]

    def _stamp(self, names: Sequence[str], aspect: str, now_ms: int, changes: DataFrame | None = None) -> None:
        """Write a new stamp, and the changes, of some topics; columns without a change keep their value."""
        rows = local_rows(self.tables.spark, [(n,) for n in sorted(set(names))], "name string")
        if changes is not None:
            rows = rows.join(changes, "name", "left")
        self.tables.update_topics(rows.withColumn(STAMPS[aspect], F.lit(now_ms).cast("long")))

    def _schema(self, names: list[str], now_ms: int) -> None:
        """Topics the registry snapshot knows get their fields replaced; others keep what they have."""
        changes = None
        if self.sources.registry is not None:
            latest = registry_source.latest(self.sources.registry).filter(F.col("topic").isin(names))
            changes = latest.select(
                F.col("topic").alias("name"), F.col("subject").alias("schema_subject"), "schema_id",
                F.col("version").alias("schema_version"), F.col("fingerprint").alias("schema_fingerprint"),
                F.col("schema_json").alias("raw_schema_json"),
            )
            self.tables.replace("fields", registry_source.flatten(latest), latest.select("topic"))
        self._stamp(names, "schema", now_ms, changes)

    def _samples(self, names: list[str], now_ms: int) -> None:
        taken = self._take_samples(names)
        keys = local_rows(self.tables.spark, [(n,) for n in names], "topic string")
        kept = taken if self.settings.retain_samples else taken.filter(F.lit(False))
        self.tables.replace("samples", kept, keys)
        self._stamp(names, "samples", now_ms)

    def _take_samples(self, names: list[str]) -> DataFrame:
        mine = self.sources.events.filter(F.col("topic").isin(names))
        sampler = self.sources.sampler or sampling.recent_samples
        rows = sampler(mine, self.settings.sample_count)
        if "value_json" not in rows.columns:
            rows = rows.withColumn("value_json", F.to_json("value", {"ignoreNullFields": "false"}))
        good, _ = privacy.usable_patterns(self.settings.patterns, self.tables.spark)
        rows = rows.select("topic", "partition", "offset", "timestamp_ms", "key", "value_json")
        return privacy.redact_samples(rows, self.settings.drop_fields, good)

    def _stats(self, names: list[str], now_ms: int) -> None:
        profile = activity.activity_profile(self.sources.events.filter(F.col("topic").isin(names)), now_ms)
        keys = local_rows(self.tables.spark, [(n,) for n in names], "topic string")
        full = keys.join(profile, "topic", "left").na.fill(0, ["messages_last_hour", "messages_last_day"]).na.fill(
            0.0, ["rate_per_minute_last_hour"]
        )
        self.tables.replace("activity", full, keys)
        self._stamp(names, "stats", now_ms)

    def _inference(self, names: list[str], now_ms: int) -> None:
        if self.sources.model is None:
            return
        topics = self.tables.read("topics").filter(F.col("name").isin(names))
        fields = self.tables.read("fields").filter(F.col("topic").isin(names))
        good, _ = privacy.usable_patterns(self.settings.patterns, self.tables.spark)
        samples = self.tables.read("samples") if self.settings.retain_samples else self._take_samples(names)
        out = annotate.annotate(
            topics, fields, samples.filter(F.col("topic").isin(names)), self.sources.model, now_ms,
            self.tables.read("annotation_cache"), self.spent(self.sources.model.name, now_ms),
            self.settings.daily_ceiling_usd, self.settings.call_estimate_usd, self.settings.drop_fields, good,
        )
        self.tables.append("annotation_cache", out.cache)
        self.tables.append("spend", out.spend)
        notes = annotate.known_annotations(fields, out.annotations)
        self.tables.replace("annotations", notes, notes.select("topic"))
        changes = out.topics.withColumnRenamed("topic", "name")
        described = [r.name for r in fields.select(F.col("topic").alias("name")).distinct().collect()]
        self._stamp(described, "inference", now_ms, changes)

    def spent(self, provider: str, now_ms: int) -> float:
        """USD spent today; one number."""
        from tidemark.functions.timeparts import utc_day

        today = self.tables.read("spend").filter((F.col("provider") == provider) & (F.col("day") == utc_day(F.lit(now_ms))))
        return float(today.agg(F.coalesce(F.sum("spend_usd"), F.lit(0.0))).first()[0])

    def _relationships(self, names: list[str], now_ms: int) -> None:
        fields = self.tables.read("fields").filter(F.col("topic").isin(names))
        samples = self.tables.read("samples").filter(F.col("topic").isin(names))
        edges = relations.sample_edges(fields, samples, now_ms, self.settings.min_overlap)
        if self.sources.scorer is not None:
            topics = self.tables.read("topics").filter(F.col("name").isin(names))
            pairs = relations.unrelated_pairs(topics, edges)
            scored, cache, spend = relations.scored_edges(
                pairs, topics, fields, self.sources.scorer, now_ms, self.tables.read("annotation_cache"),
                self.spent(self.sources.scorer.name, now_ms), self.settings.daily_ceiling_usd,
                self.settings.call_estimate_usd, self.settings.score_threshold,
            )
            edges = edges.unionByName(scored)
            self.tables.append("annotation_cache", cache)
            self.tables.append("spend", spend)
        keys = local_rows(self.tables.spark, [(n,) for n in names], "source_topic string")
        self.tables.replace("relationships", edges, keys)


def ensure_fresh(refresh: Refresh, topic: str, now_ms: int) -> DataFrame:
    """Refresh the stale aspects of one topic and return its row."""
    refresh.once([topic], now_ms, relationships=False)
    return refresh.tables.read("topics").filter(F.col("name") == topic)


def refresh_loop(refresh: Refresh, names: Iterable[str], interval_sec: float, cycles: int | None = None) -> None:
    """Refresh on an interval; a scheduler that runs :meth:`Refresh.once` does the same."""
    done = 0
    while cycles is None or done < cycles:
        refresh.once(names, int(time.time() * 1000))
        done += 1
        if cycles is None or done < cycles:
            time.sleep(interval_sec)
