"""Mixing sources to target weights by a hash threshold for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import WORD, stored, text_of

# Bits of the 60-bit hash in which the first and the second histogram count.
BITS = 12
# With at most so many sources, their thresholds (40 bytes each, and the name) are broadcast.
MAX_BROADCAST_SOURCES = 10_000


def mix_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text (of an empty text if it is null)."""
    digest = F.md5(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _key(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int
) -> DataFrame:
    """``key, source_size, target`` of each source of ``sizes`` (``key, h, size``).

    Sources in code-point order, null last, get the weights in turn and share ``share`` of all
    words in proportion. No target is above ``max_repeats`` times its source's size; what is
    above is shared again among the others. That ends where target = min(cap, level * weight)
    for one common level, which a running sum over the sources by cap / weight finds.
    """
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    # The key of null is empty, and the others begin with "=".
    order = Window.partitionBy().orderBy((F.col("key") == "").cast("int"), "key")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    caps = sources.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * F.lit(float(max_repeats))
    )
    everything = Window.partitionBy()
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if all sources before this one, and no other, are at their caps.
    levels = caps.withColumn("level", (budget - capped) / weight_left)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(everything)
    return levels.withColumn("common", level["level"]).select(
        "key",
        "source_size",
        F.when(F.col("common").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("common") * F.col("weight")))
        .alias("target"),
    )


def _boundary(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Of each group the bucket in which the running sum of ``words`` passes ``left``, and how much
    is left there."""
    order = Window.partitionBy(*keys).orderBy(bucket)
    upto = counts.withColumn("upto", F.sum("words").over(order))
    inside = (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left"))
    left = F.col("left") - (F.col("upto") - F.col("words"))
    return upto.where(inside).select(*keys, bucket, left.alias("left"))


def thresholds(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3
) -> DataFrame:
    """``key, source_size, target, full, cut``: every document of a source is taken ``full`` times,
    and once more if its hash is at most ``cut``. ``sizes`` has ``key, h, size``.

    Words are summed by source and hash bucket. Where the running sum passes what is still wanted,
    only that bucket is counted again in finer buckets, and only documents in one of those are looked
    at one by one; the sum nearest to the target wins there. Documents of equal hash go together. As
    one hash decides, a smaller share takes a part of what a larger one takes.
    """
    targets = source_targets(sizes, weights, share, max_repeats)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("full", full.cast("int"))
    rest = F.col("target") - F.col("full") * F.col("source_size")
    targets = stored(targets.withColumn("left", rest), "mix-targets")

    wanted = targets.where(F.col("left") > 0).select("key", "left")
    coarse, fine = F.shiftright("h", 60 - BITS), F.shiftright("h", 60 - 2 * BITS)
    first = sizes.groupBy("key", coarse.alias("b1")).agg(F.sum("size").alias("words")).join(wanted, "key")
    first = _boundary(first, ["key"], "b1")
    inside = sizes.withColumn("b1", coarse).join(first, ["key", "b1"])
    second = inside.groupBy("key", fine.alias("b2"), "left").agg(F.sum("size").alias("words"))
    second = _boundary(second, ["key"], "b2")
    leaf = sizes.withColumn("b2", fine).join(second, ["key", "b2"])
    leaf = leaf.groupBy("key", "b2", "h", "left").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("h"))
    nearer = 2 * F.col("left") > 2 * F.col("upto") - F.col("words")
    start = F.shiftleft("b2", 60 - 2 * BITS) - 1
    cuts = (
        leaf.withColumn("upto", upto)
        .groupBy("key")
        .agg(F.coalesce(F.max(F.when(nearer, F.col("h"))), F.min(start)).alias("cut"))
    )
    return targets.join(cuts, "key", "left").select(
        "key", "source_size", "target", "full", F.coalesce("cut", F.lit(-1)).alias("cut")
    )


def _with_thresholds(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows joined to the thresholds of their ``key``."""
    limits = stored(limits, "mix-thresholds")
    few = limits.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    return rows.join(F.broadcast(limits) if few else limits, "key")


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, h, size`` of each document, written down: texts are read once."""
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("bigint")
    rows = docs.select(
        "doc_id", _key(docs["source"]).alias("key"), mix_hash(docs["doc_id"]).alias("h"), size.alias("size")
    )
    return stored(rows, "mix-sizes")


def copies() -> Column:
    """How often a document is taken, of a row with its thresholds."""
    return F.col("full") + (F.col("h") <= F.col("cut")).cast("int")


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs`` (``doc_id, text, source``).

    Whole documents are taken, each up to ``max_repeats`` times. A null or empty text has size 0; a
    null source is a source of its own, and so is an empty one; a null id is hashed as an empty one.
    Rows of one id are taken together. No rows give no rows. Extra columns are ignored.
    """
    sizes = document_sizes(docs)
    mixed = _with_thresholds(sizes, thresholds(sizes, weights, share, max_repeats))
    taken = F.col("size") * copies()
    return mixed.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row taken several times as several rows.

    Columns stay as they are; see :func:`plan_mix` for the rule.
    """
    limits = thresholds(document_sizes(docs), weights, share, max_repeats)
    packed = docs.select(
        F.struct("*").alias("row"), _key(docs["source"]).alias("key"), mix_hash(docs["doc_id"]).alias("h")
    )
    taken = _with_thresholds(packed, limits).where(copies() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), copies())).alias("copy")).select("row.*")
