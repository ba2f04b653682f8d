"""Calling a text model from Spark tasks, with a cache in front."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeparts import utc_day
from tidemark.operators import budget
from tidemark.session import null_safe_join, written_once


@dataclass(frozen=True)
class Model:
    """A named completion function: one prompt in, (text, USD) out. Runs inside tasks."""

    name: str
    complete: Callable[[str], tuple[str, float]]
    #: What a call is expected to cost at most, for admission under a spend ceiling.
    call_usd: float = 0.01
    #: Calls that one task has under way; a task waits for answers, it does not compute them.
    at_once: int = 4


def latest_cache(cache: DataFrame) -> DataFrame:
    """The newest payload per key; JSON that does not parse counts as absent."""
    newest = cache.groupBy("cache_key").agg(F.max_by("payload_json", F.struct("created_ms", "payload_json")).alias("payload_json"))
    return newest.filter(F.try_parse_json("payload_json").isNotNull())


def split_cached(asked: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows answered by the cache with ``payload_json``, rows still to ask)."""
    if cache is None:
        return asked.withColumn("payload_json", F.lit(None).cast("string")).filter(F.lit(False)), asked
    known = latest_cache(cache)
    return asked.join(known, "cache_key"), asked.join(known, "cache_key", "left_anti")


def ask(
    asked: DataFrame,
    model: Model,
    keep: Sequence[str],
    cache: DataFrame | None = None,
    spent: float = 0.0,
    ceiling: float = 1.0,
    estimate: float | None = None,
) -> DataFrame:
    """Answer the ``prompt`` of every row that can be answered, with one call for each ``cache_key``.

    Returns the kept columns, ``cache_key``, the cached ``payload_json`` if there is one, ``admitted``,
    and for admitted rows ``text``, ``cost`` and ``error``; of rows that share a key one carries the cost. Cached keys are not
    asked. The others are asked in waves: each admits as many calls as fit what is left of the ceiling at ``estimate``
    (by default the model's own) and settles what they really cost before the next, so a spend over the ceiling is at most
    the error of one wave's estimates. A failed call gives null text and its error; it does not fail the job. Prompts, the
    answers of every wave and what it leaves waiting are written to the shared folder, because asking again could cost money and
    answer differently.
    """
    each = model.call_usd if estimate is None else estimate
    prompts = written_once(asked.withColumn("_row", F.monotonically_increasing_id()), "prompts")
    # The first row of every key asks for all of them. Who may ask is settled without the prompts, which meet their calls in one join.
    waiting = prompts.groupBy("cache_key").agg(F.min("_row").alias("_row")).select("_row", "cache_key")
    if cache is None:
        waiting = waiting.withColumn("payload_json", F.lit(None).cast("string"))
    else:
        waiting = waiting.join(latest_cache(cache), "cache_key", "left")
    waves = []
    while True:
        marked = budget.mark_admitted(waiting, "cache_key", F.col("payload_json").isNull(), each, spent, ceiling)
        asking = marked.join(prompts.select("_row", "prompt"), "_row")
        answers = written_once(_call(asking, model, ["_row", "cache_key", "payload_json", "admitted"]), "answers")
        turned_away = ~F.col("admitted") & F.col("payload_json").isNull()
        tally = answers.agg(
            F.count_if("admitted").alias("made"), F.count_if(turned_away).alias("left"),
            F.coalesce(F.sum(F.when(F.col("admitted"), budget.units(F.col("cost")))), F.lit(0)).alias("units"),
        ).first()
        spent += tally.units / budget.UNITS
        if not tally.left or not tally.made or spent >= ceiling:
            break
        # What was turned away waits for the next wave.
        waves.append(answers.filter(~turned_away))
        waiting = answers.filter(turned_away).select("_row", "cache_key")
        waiting = waiting.withColumn("payload_json", F.lit(None).cast("string"))
    for wave in waves:
        answers = answers.unionByName(wave)
    both = null_safe_join(prompts.drop("prompt"), answers.withColumnRenamed("_row", "_first"), ["cache_key"])
    cost = F.when(F.col("_row") == F.col("_first"), F.col("cost")).otherwise(F.lit(0.0))
    return both.select(*keep, "cache_key", "payload_json", "admitted", "text", cost.alias("cost"), "error")


def _call(marked: DataFrame, model: Model, kept: Sequence[str]) -> DataFrame:
    """One call of the model for every admitted row, up to ``model.at_once`` of a task at a time."""
    schema = T.StructType([marked.schema[c] for c in kept])
    schema = schema.add("text", "string").add("cost", "double").add("error", "string")

    def answer(row: tuple[str, bool]) -> tuple[str | None, float, str | None]:
        prompt, admitted = row
        if not admitted:
            return None, 0.0, None
        try:
            text, cost = model.complete(prompt)
            return text, float(cost), None
        except Exception as exc:
            return None, 0.0, str(exc)[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(model.at_once) as pool:
            for batch in batches:
                answers = list(pool.map(answer, zip(batch["prompt"], batch["admitted"], strict=True)))
                columns = pd.DataFrame(answers, columns=["text", "cost", "error"], index=batch.index)
                yield pd.concat([batch[list(kept)], columns], axis=1)

    return marked.select(*kept, "prompt").mapInPandas(run, schema)


def spend_rows(answers: DataFrame, provider: str, now_ms: int) -> DataFrame:
    return answers.filter(F.col("admitted")).select(
        utc_day(F.lit(now_ms)).alias("day"), F.lit(provider).alias("provider"), F.col("cost").alias("spend_usd")
    )
