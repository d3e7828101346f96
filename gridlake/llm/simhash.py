"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import pieces, raw_texts, stored, unused

BITS = 64
# The key parts of the first look: the fingerprint without one of these ranges of bits.
_THIRDS = ((0, 21), (21, 42), (42, 64))
# Hashes whose bits are counted at once.
_COUNT = 1 << 16
# A group with at most so many strays compares each of them with all its members.
FEW_STRAYS = 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of ``words`` words, as a signed 64-bit number.

    A-Z are lower-cased; words are separated by ASCII white space; shingles are joined by single
    spaces, and repeated ones count each time. A bit is set if it is set in over half of the XXH64
    hashes. Fewer words make one shingle; no words give 0.
    """
    found = text.lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _COUNT):
        part = hashes[at : at + _COUNT].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = [fingerprint(raw, words, seed) for raw in raw_texts(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["copy"], pa.array(values, pa.int64())], names=["doc_id", "copy", "fp"]
        )


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, copy, fp`` of each row, written down. ``copy`` is a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    found = rows.mapInArrow(
        lambda batches: _fingerprints(batches, words, seed), f"doc_id {kind}, copy bigint, fp bigint"
    )
    return stored(found, "simhash")


def _flips(fp: Column, bits: Iterable[int]) -> Column:
    """An array of ``fp`` as it is and with each one of ``bits`` flipped."""
    masks = [0, *[_signed(1 << b) for b in bits]]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: fp.bitwiseXOR(m))


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """``fp, variant`` of ``fps`` (``fp, mask``): every number within ``radius`` bits of ``fp``, once.

    Only bits of ``mask`` are flipped.
    """
    out = fps.select("fp", "mask", F.col("fp").alias("variant"), F.lit(-1).alias("last"))
    for _ in range(radius):
        # Bits are flipped in ascending order; number 64 stands for none.
        bits = F.expr(
            "filter(sequence(least(last + 1, 64), 64), b -> b = 64 OR (mask & shiftleft(1L, b)) <> 0)"
        )
        out = out.select("fp", "mask", "variant", F.explode(bits).alias("last"))
        flip = F.when(F.col("last") < 64, F.expr("shiftleft(1L, last)")).otherwise(F.lit(0).cast("bigint"))
        out = out.select("fp", "mask", F.col("variant").bitwiseXOR(flip).alias("variant"), "last")
    return out.select("fp", "variant")


def _tied(variants: DataFrame, distance: int) -> DataFrame:
    """``u, v`` with ``u < v``: pairs that connect all that meet in a variant of ``fp, variant``.

    A home is a fingerprint within ``distance // 2`` bits of the variant. Whatever meets a home is
    within ``distance`` of it, and two fingerprints within ``distance`` meet where one is a home. So
    each is tied to the smallest home only: a group grows by rows, not by pairs.
    """
    home = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= distance // 2
    smallest = F.min(F.when(home, F.col("fp"))).over(Window.partitionBy("variant"))
    pairs = variants.select("fp", smallest.alias("home")).where("home <> fp")
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= distance)
    return pairs.select(F.least("fp", "home").alias("u"), F.greatest("fp", "home").alias("v")).distinct()


def _meetings(fps: DataFrame) -> DataFrame:
    """``group, fp, smallest, mask`` of the fingerprints that meet others in most of their bits.

    Up to 4 bits that differ leave a pair of thirds with 2 at most. So each fingerprint emits, for
    each pair of thirds, its variants within half of that, 1 bit: about 130 rows, and what links
    meets. ``mask`` has the bits on which the members of a group differ. The third left out is
    overwritten by its number; where that equals a variant of another pair of thirds, a group only
    gets members more.
    """
    keys = []
    for k, (low, high) in enumerate(_THIRDS):
        kept = [b for b in range(BITS) if not low <= b < high]
        mask = _signed(sum(1 << b for b in kept))
        marked = F.col("fp").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(_signed((k + 1) << low)))
        keys.append(_flips(marked, kept))
    spread = fps.select("fp", F.explode(F.concat(*keys)).alias("group"))
    group = Window.partitionBy("group")
    met = spread.select(
        "group",
        "fp",
        F.min("fp").over(group).alias("smallest"),
        F.bit_or("fp").over(group).alias("any"),
        F.bit_and("fp").over(group).alias("every"),
    )
    mask = F.col("any").bitwiseAND(F.bitwise_not("every"))
    return met.select("group", "fp", "smallest", mask.alias("mask")).where("mask <> 0")


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``u, v`` with ``u < v``: enough pairs of linked fingerprints to connect all that link.

    ``fps`` has distinct ``fp``. Every fingerprint emits all variants within half the distance (for
    an odd one, within the half rounded up), and what meets in a variant is verified.

    For distances up to 4 that is done in three steps. First over pairs of thirds, where fewer
    variants do: within each group all are compared with its smallest. A group whose members are
    all connected by then, or that has only two, is settled. In all other groups the strays, which are
    not of the group's most frequent component, are compared with all members: of two that link
    and are not connected yet, one is a stray. Where a group has more than ``FEW_STRAYS``, its
    members emit their whole balls instead, over the bits on which they differ: two that link
    meet in such a group, and so in a variant of those bits.
    """
    if distance > 4:
        everything = F.lit(-1).cast("bigint")
        return _tied(_ball(fps.select("fp", everything.alias("mask")), -(-distance // 2)), distance)
    met = stored(_meetings(fps), "simhash-met")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("smallest"))) <= distance
    star = met.where((F.col("smallest") < F.col("fp")) & near)
    star = stored(star.select(F.col("smallest").alias("u"), F.col("fp").alias("v")).distinct(), "simhash-star")
    roots = components(star).withColumnRenamed("node", "fp")
    root = F.coalesce("root", "fp")
    named = stored(met.join(roots, "fp", "left").select("group", "fp", "mask", root.alias("root")), "simhash-named")
    per_root = named.groupBy("group", "root").agg(F.count("*").alias("n"))
    open_groups = per_root.groupBy("group").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("members"))
    open_groups = open_groups.where("members > most.n AND members > 2").select(
        "group", F.col("most.root").alias("common"), (F.col("members") - F.col("most.n")).alias("strays")
    )
    open_groups = stored(open_groups, "simhash-groups")
    few = F.col("strays") <= FEW_STRAYS
    tied = _strays_tied(named, open_groups.where(few), distance)
    many = named.join(open_groups.where(~few).select("group"), "group", "left_semi")
    open_fps = stored(many.groupBy("fp").agg(F.bit_or("mask").alias("mask")), "simhash-open")
    return star.union(tied).union(_tied(_ball(open_fps, -(-distance // 2)), distance))


def _strays_tied(named: DataFrame, groups: DataFrame, distance: int) -> DataFrame:
    """``u, v`` with ``u < v``: the links of strays with members of their groups.

    ``named`` has ``group, fp, root``; ``groups`` has ``group, common`` of groups with few strays, and
    ``common`` is the root of all other members.
    """
    strays = named.join(groups.select("group", "common"), "group").where("root <> common")
    strays = strays.groupBy("group").agg(F.collect_set("fp").alias("strays"))
    linked = F.filter(
        "strays",
        lambda s: (s != F.col("fp")) & (F.bit_count(s.bitwiseXOR(F.col("fp"))) <= distance),
    )
    pairs = named.join(strays, "group").select("fp", F.explode(linked).alias("stray"))
    return pairs.select(F.least("fp", "stray").alias("u"), F.greatest("fp", "stray").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``u, v``); ``root`` is the smallest in reach.

    Alternating stars: edges are pointed to the smallest neighbour, from larger neighbours and then
    from smaller ones, until nothing changes. Each round writes its edges down.
    """
    edges = stored(edges, "edges")
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            break
        state = mark
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        large = stored(large, "edges")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.explode(F.array(F.struct("m", F.col("u").alias("x")), F.struct("m", F.col("v").alias("x")))).alias("e"))
        small = small.where("e.m < e.x").select(F.col("e.m").alias("u"), F.col("e.x").alias("v")).distinct()
        edges = stored(small, "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """``fp, component_id, keep`` of each fingerprint: the smallest document id of its component, and
    the first row of it by id and text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")).alias("first")
    nodes = stored(rows.groupBy("fp").agg(first), "simhash-nodes")
    roots = stored(components(links(nodes.select("fp"), distance)), "simhash-roots")
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    linked = linked.join(best, "root").select("fp", "best")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("best", "first").alias("keep"))
    return stored(classes.select("fp", F.col("keep.doc_id").alias("component_id"), "keep"), "simhash-classes")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs`` (``doc_id, text``).

    Fingerprints link at ``distance`` or fewer bits; a component is what links reach, and is named by
    its smallest id. Copies share one fingerprint, so links are between different ones only.

    A null or empty text, or one without words, has fingerprint 0, linked like any other. Null ids do
    not name a component; one without other ids has a null name. Repeated rows each get their row. No
    rows give no rows. Extra columns are ignored.
    """
    rows = fingerprints(docs.select("doc_id", "text"), words, seed)
    named = rows.join(_classes(rows, distance), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return named.select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row of each component: that of the smallest id, with null ids last, and of the smallest text
    hash among equal ids. All columns stay as they are.
    """
    rows = fingerprints(docs.select("doc_id", "text"), words, seed)
    keep = _classes(rows, distance).select("keep").distinct()
    mine, theirs = unused(docs, "text_hash"), unused(docs, "keep")
    kept = docs.withColumn(mine, F.xxhash64("text")).join(
        keep.withColumnRenamed("keep", theirs),
        docs["doc_id"].eqNullSafe(F.col(theirs)["doc_id"]) & (F.col(mine) == F.col(theirs)["copy"]),
    )
    # Rows that agree in both are copies of each other.
    return kept.dropDuplicates(["doc_id", mine]).select(*docs.columns)
