"""Merkle dataset manifest (operator 13): a root hash over a dataset, and a proof for every document.

A document's leaf is the hash of its fields. Within a source, leaves stand by ascending ``doc_id``; every ``FANOUT``
consecutive nodes have one parent, up to the source's subroot, and subroots by source go on in the same way up to the root.

Leaves are not sorted to learn their places. The ids of a source are a bitmap: one row for each word of 64 ids in which
there are any, so a source with few ids has few words. A directory counts ids above the words in steps of 16 bits of the
id; each step is a running sum over at most 65,536 entries, however many documents a source has. A document's coordinate
is then the directory's counts plus the ones below its bit (popcount). Equal coordinates, divided by ``FANOUT``, key the slots of a run;
a run is an array of at most ``FANOUT`` slots, and reducing a level is one grouped aggregate over such keys.

Proofs come down the same tables: a run meets its parent's path by (source, run), so no key is hot and no path is
collected for more than ``FANOUT`` nodes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.text_columns import plain_lower

FANOUT = 16
_SLOT_BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bitmap word of rows without an id; below those of all ids, so that such rows come first.
_NO_ID = -(1 << 62)
_KEY = ["no_source", "group"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]).cast("binary"), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """source, doc_id, leaf, tampered (the leaf with text in lower case; null where nothing is tampered with), once per
    distinct row with its number ``n``."""
    doc_id = docs[id_col].cast("long")
    lowered = leaf_hash([plain_lower(docs[c].cast("string")) if c == text_col else docs[c] for c in fields])
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        docs[source_col].isNull().alias("no_source"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("group"),
        doc_id.alias("doc_id"), leaf_hash([docs[c] for c in fields]).alias("leaf"), F.when(chosen, lowered).alias("tampered"),
    )
    return rows.groupBy(*_KEY, "doc_id", "leaf", "tampered").agg(F.count("*").alias("n"))


def _before(by: list[str], order: str, count: str = "n") -> Column:
    """Sum of ``count`` over the rows before, among those that agree on ``by``."""
    return F.coalesce(F.sum(count).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def bitmap_directory(rows: DataFrame) -> DataFrame:
    """Bitmap words of the ids of every group, each with the rows before it (``base``) and the rows of its group (``total``).

    ``rows`` has the key, word, bit and n. A word whose ids all have one row needs its bits only; ids with several rows stand in ``more``.
    """
    ids = rows.repartition(*_KEY, "word").groupBy(*_KEY, "word", "bit").agg(F.sum("n").alias("n"))
    one = F.lit(1).cast("long")
    words = written(
        ids.groupBy(*_KEY, "word").agg(
            F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("bits"), F.sum("n").alias("n"),
            F.collect_list(F.when(F.col("n") > 1, F.struct("bit", "n"))).alias("more"),
        ), "bitmap-words",
    )
    blocks = words.groupBy(*_KEY, F.shiftright("word", 10).alias("block")).agg(F.sum("n").alias("n"))
    regions = blocks.groupBy(*_KEY, F.shiftright("block", 16).alias("region")).agg(F.sum("n").alias("n"))
    tops = regions.groupBy(*_KEY, F.shiftright("region", 16).alias("top")).agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*_KEY))
    tops = tops.select(*_KEY, "top", _before(_KEY, "top").alias("base"), whole.alias("total"))

    def below(counts: DataFrame, own: str, above: DataFrame, name: str) -> DataFrame:
        part = counts.withColumn(name, F.shiftright(own, 10 if name == "block" else 16))
        inner = part.withColumn("inner", _before([*_KEY, name], own))
        return inner.join(above, [*_KEY, name]).withColumn("base", F.col("base") + F.col("inner")).drop("inner", name)

    regions = below(regions, "region", tops, "top").drop("n")
    blocks = below(blocks, "block", regions, "region").drop("n")
    return below(words, "word", blocks, "block").drop("n")


def coordinates(unique: DataFrame) -> DataFrame:
    """The rows of ``leaves``, each as often as it occurs, with ``idx``, its place in its group from 0, and ``total``.

    Rows of one id stand by leaf; equal rows take neighbouring places.
    """
    rows = unique.withColumn("word", F.coalesce(F.shiftright("doc_id", 6), F.lit(_NO_ID)))
    rows = rows.withColumn("bit", F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int"))
    words = bitmap_directory(rows.select(*_KEY, "word", "bit", "n"))
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))
    extra = F.aggregate("more", F.lit(0).cast("long"), lambda acc, m: acc + F.when(m.bit < F.col("bit"), m.n - 1).otherwise(F.lit(0)))
    placed = rows.join(words, [*_KEY, "word"]).select(
        *_KEY, "doc_id", "leaf", "tampered", "n", "total",
        (F.col("base") + F.bit_count(F.col("bits").bitwiseAND(lower)) + extra).alias("idx"),
        F.exists("more", lambda m: m.bit == F.col("bit")).alias("tied"),
    )
    placed = written(placed, "leaf-places")
    single = placed.where(~F.col("tied")).drop("tied", "n")
    # Rows that share an id: counts by the first 16 bits of the leaf, then a running sum inside these.
    tied = placed.where("tied").withColumn("digit", F.substring("leaf", 1, 4))
    digits = tied.groupBy(*_KEY, "idx", "digit").agg(F.sum("n").alias("n"))
    digits = digits.select(*_KEY, "idx", "digit", _before([*_KEY, "idx"], "digit").alias("outer"))
    tied = tied.withColumn("inner", _before([*_KEY, "idx", "digit"], "leaf")).join(digits, [*_KEY, "idx", "digit"])
    tied = tied.withColumn("idx", F.col("idx") + F.col("outer") + F.col("inner"))
    # Equal rows, in two steps so that no array grows with their number.
    tied = tied.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))).alias("step"))
    each = F.explode(F.sequence(F.col("step") * 1000, F.least(F.col("n"), F.col("step") * 1000 + 1000) - 1))
    tied = tied.select("*", each.alias("copy")).withColumn("idx", F.col("idx") + F.col("copy"))
    return single.unionByName(tied.select(*single.columns))


def _levels(total: Column) -> Column:
    """Levels of runs above ``total`` nodes; one for a lone node, whose run passes it on."""
    return F.greatest(F.size(F.filter(F.array(*[F.lit(FANOUT**k) for k in range(16)]), lambda p: p < total)), F.lit(1))


def _whole(slots: Column | str) -> Column:
    return F.array_join(F.transform(slots, lambda s: s.hash), "")


def reduce_levels(nodes: DataFrame, payload: list[str], label: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, and key, total and hash of every group's top node.

    ``nodes`` has the key, idx, hash and total; ``payload`` columns stay with the lowest level's slots.
    """
    deepest = nodes.agg(F.max(_levels(F.col("total")))).first()[0] or 0  # one number
    runs, tops, level = [], None, nodes
    for k in range(deepest):
        slot = F.struct(F.col("idx").bitwiseAND(FANOUT - 1).cast("int").alias("slot"), "hash", *(payload if k == 0 else []))
        made = level.groupBy(*_KEY, "total", F.shiftright("idx", _SLOT_BITS).alias("run")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        runs.append(written(made, f"{label}-{k}"))
        parent = F.when(F.col("total") == 1, _whole("slots")).otherwise(F.sha2(_whole("slots").cast("binary"), 256))
        level = runs[-1].select(*_KEY, "total", F.col("run").alias("idx"), parent.alias("hash"))
        done = level.where(_levels(F.col("total")) == k + 1).drop("idx")
        tops = done if tops is None else tops.unionByName(done)
        level = level.where(_levels(F.col("total")) > k + 1)
    return runs, nodes.drop("idx", *payload) if tops is None else tops


def descend(runs: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """Lowest nodes with ``path`` (concatenated run and own slot of every level, from the lowest on) and the ``carry`` columns of their top.

    ``tops`` has the key, total, the path above it and the carried columns.
    """
    parents = None
    for k in reversed(range(len(runs))):
        start = tops.where(_levels(F.col("total")) == k + 1).select(*_KEY, F.lit(0).cast("long").alias("run"), "path", *carry)
        parents = start if parents is None else parents.unionByName(start)
        each = runs[k].join(parents, [*_KEY, "run"]).select("*", _whole("slots").alias("whole")).select("*", F.explode("slots").alias("s"))
        step = F.array(F.struct(F.col("whole").alias("nodes"), F.col("s.slot").alias("slot")))
        path = F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(step, "path"))
        place = (F.col("run") * FANOUT + F.col("s.slot"))
        if k:
            parents = each.select(*_KEY, place.alias("run"), path.alias("path"), *carry)
        else:
            parents = each.select(*_KEY, place.alias("idx"), path.alias("path"), "s.*", *carry)
    return parents


def _ranked(tops: DataFrame) -> DataFrame:
    """Top nodes with ``idx``, the place of their source: null first, then by bytes."""
    order = [F.col("no_source").desc(), F.col("group")]
    rows = written(tops.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    parts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    # One row per partition of the written table.
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    whole = F.lit(rows.count())
    both = rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part")
    return both.select(*_KEY, "total", "hash", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("idx"), whole.alias("sources"))


def _others(step: Column) -> tuple[Column, Column]:
    return F.substring(step.nodes, F.lit(1), 64 * step.slot), F.substring(step.nodes, 64 * step.slot + 65, F.lit(64 * FANOUT))


def _siblings(step: Column) -> Column:
    return F.concat(*_others(step))


def _fold(acc: Column, step: Column) -> Column:
    left, right = _others(step)
    return F.sha2(F.concat(left, acc, right).cast("binary"), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, source, idx (place in its source), leaf, subroot, root, proof (hashes of the siblings, joined), proof_sha256,
    folded_root and verified of every row.

    A null source is a source of its own and comes first. Rows with a null id come first in their source and are not
    tampered with. Rows of one id stand by leaf, repeated rows beside each other, each with a leaf of its own. Null fields and empty
    texts have leaves like any other; a null text stays null when tampered with. Other columns take no part. An empty table has no rows.
    """
    unique = written(leaves(docs, id_col, source_col, text_col, fields), "manifest-leaves")
    nodes = coordinates(unique).withColumnRenamed("leaf", "hash")
    runs, tops = reduce_levels(nodes, ["doc_id", "tampered"], "leaf-runs")
    sources = written(_ranked(tops), "subroots")
    top_nodes = sources.select(F.lit(False).alias("no_source"), F.lit("").alias("group"), "idx", "hash", F.col("sources").alias("total"))
    top_runs, root = reduce_levels(top_nodes, [], "source-runs")
    step = "array<struct<nodes:string,slot:int>>"
    start = root.select(*_KEY, "total", F.array().cast(step).alias("path"), F.col("hash").alias("root"))
    if not top_runs:
        return docs.limit(0).select(
            F.lit(0).cast("long").alias("doc_id"), F.lit("").alias("source"), F.lit(0).cast("long").alias("idx"),
            *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof", "proof_sha256", "folded_root")], F.lit(True).alias("verified"),
        )
    paths = descend(top_runs, start, ["root"]).select("idx", "path", "root")
    above = sources.withColumnRenamed("hash", "subroot").join(paths, "idx").select(*_KEY, "total", "path", "subroot", "root")
    rows = descend(runs, written(above, "source-paths"), ["subroot", "root"])
    proof = F.array_join(F.transform("path", _siblings), "")
    rows = rows.select(
        "doc_id", F.when(~F.col("no_source"), F.col("group")).alias("source"), "idx", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof"),
        F.aggregate("path", F.coalesce("tampered", "hash"), _fold).alias("folded_root"),
    )
    return rows.withColumns({"proof_sha256": F.sha2(F.col("proof").cast("binary"), 256), "verified": F.col("folded_root") == F.col("root")})
