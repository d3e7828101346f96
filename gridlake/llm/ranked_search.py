"""Ranked lexical search: exact inner products over ball trees of sparse document vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gridlake.llm.common import flat, pieces, slices, stored

# Bytes of items that are looked for at once; more are looked for in several scans.
ITEM_BYTES = 4 << 20
# Numbers in the vectors of one tree, and documents of a leaf.
TREE, LEAF = 1 << 20, 64

# Terms are runs of digits, letters and non-ASCII characters: in UTF-8, A-Z become a-z and all other
# ASCII bytes become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of it at a time."""
    for part in slices(text.translate(_FOLD)):
        yield part.split()


# --- vectors -------------------------------------------------------------------------------------


def _counts(batches: Iterable[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value.get
    for batch in pieces(batches):
        data, at = flat(batch["text"])
        raw = data.tobytes()
        lengths, ids, tfs = [], [], []
        for start, end in zip(at.tolist(), at[1:].tolist()):
            n, found = 0, []
            for words in terms_of(raw[start:end]):
                n += len(words)
                numbers = np.fromiter(map(known, words, repeat(-1)), np.int32, len(words))
                found.append(numbers[numbers >= 0])
            which, times = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_counts=True)
            lengths.append(n)
            ids.append(which.astype(np.int32))
            tfs.append(times)
        ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
        none = np.zeros(0, np.int32)
        columns = [
            batch["doc_id"],
            pa.array(lengths, pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *ids]), pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *tfs]), pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each row of ``docs``, written down: the number of all its terms, and
    the numbers and counts of those in ``vocabulary``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    found = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _counts(batches, shared), f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>"
    )
    return stored(found, "search-counts")


@dataclass
class Weights:
    """What scores are made of: the weight of each term, documents with terms, and all their terms."""

    w: np.ndarray
    documents: int
    terms: int

    def values(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Integer value of terms that occur ``tf`` times in documents of ``n`` terms."""
        m = 100 - 75 + (75 * n * self.documents) // self.terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weigh(counts: DataFrame, size: int) -> Weights:
    """Weights of the terms of a vocabulary of ``size``, over all documents."""
    totals = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    w = np.zeros(size, np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        w[row["term"]] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * row["df"] + 1)))
    return Weights(w, totals[0], totals[1] or 1)


# --- ball trees ----------------------------------------------------------------------------------


@dataclass
class Vectors:
    """Sparse rows: those from ``at[k]`` on, up to ``at[k + 1]``, are of row ``k``."""

    at: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = np.diff(self.at)[rows]
        at = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.at[rows] - at[:-1], sizes) + np.arange(at[-1])
        return Vectors(at, self.terms[source], self.values[source])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.terms], self.at[:-1])

    def row(self, k: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[self.terms[self.at[k] : self.at[k + 1]]] = self.values[self.at[k] : self.at[k + 1]]
        return out


@dataclass
class BallTree:
    """Balls around groups of vectors, halved until they are small.

    ``centres`` are kept by term, for the inner products of one query with all of them; radii are rounded
    up by more than the arithmetic can be off. ``leaves`` have rows, the others two children.
    """

    radius: np.ndarray
    children: list[tuple[int, int] | None]
    leaves: dict[int, np.ndarray]
    at: np.ndarray
    nodes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, vectors: Vectors, width: int, leaf: int = LEAF) -> BallTree:
        radius: list[float] = []
        children: list[tuple[int, int] | None] = []
        leaves: dict[int, np.ndarray] = {}
        centres: list[tuple[np.ndarray, np.ndarray]] = []

        def build(part: Vectors, rows: np.ndarray) -> int:
            node = len(radius)
            centre = np.bincount(part.terms, part.values, width) / len(part)
            norms = np.add.reduceat(part.values**2, part.at[:-1])
            around = float(centre @ centre)
            far = norms - 2 * part.dot(centre) + around + 1e-9 * (norms + around)
            radius.append(math.sqrt(max(float(far.max()), 0.0)) * (1 + 1e-9))
            some = np.flatnonzero(centre)
            centres.append((some, centre[some]))
            children.append(None)
            if len(part) <= leaf:
                leaves[node] = rows
                return node
            # By which is nearer: a vector far from the centre, or one far from that. Halves, if that
            # leaves few on one side.
            first = int(far.argmax())
            one = part.row(first, width)
            second = int((norms - 2 * part.dot(one)).argmax())
            along = norms[first] - norms[second] - 2 * part.dot(one - part.row(second, width))
            order = np.argsort(along, kind="stable")
            half = int(np.searchsorted(along[order], 0.0))
            if min(half, len(order) - half) * 16 < len(order):
                half = len(order) // 2
            children[node] = tuple(build(part.take(side), rows[side]) for side in (order[:half], order[half:]))
            return node

        build(vectors, np.arange(len(vectors)))
        terms = np.concatenate([t for t, _ in centres])
        order = np.argsort(terms, kind="stable")
        nodes = np.repeat(np.arange(len(centres)), [len(t) for t, _ in centres])[order]
        at = np.searchsorted(terms[order], np.arange(width + 1))
        return cls(np.array(radius), children, leaves, at, nodes, np.concatenate([v for _, v in centres])[order])

    def bounds(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each node, more than any inner product of the query with a vector below can be."""
        spans = [(slice(self.at[t], self.at[t + 1]), v) for t, v in zip(terms.tolist(), values.tolist())]
        nodes = np.concatenate([np.zeros(0, np.int64), *[self.nodes[s] for s, _ in spans]])
        parts = np.concatenate([np.zeros(0), *[self.values[s] * v for s, v in spans]])
        inner = np.bincount(nodes, parts, len(self.radius))
        return (inner + math.sqrt(float(values @ values)) * self.radius) * (1 + 1e-9) + 1


@dataclass
class Query:
    """An item's distinct terms, how often each occurs, and the best documents so far."""

    number: int
    item_id: object
    terms: np.ndarray
    times: np.ndarray
    best: list[tuple] = field(default_factory=list)  # (-score, id is null, id), ascending


def _search_tree(vectors: Vectors, exact: np.ndarray, ids: list, w: np.ndarray, queries: list[Query], k: int) -> None:
    """Improve the ``k`` best documents of each query by those of one tree.

    ``vectors`` are weighted by the root of the terms' weights, and so are queries. The node of the
    greatest bound comes first; when that is below the ``k``-th score there is nothing more to find.
    Leaves are scored by the integers ``exact``, weight times value, as long as those of ``vectors``.
    """
    local = np.unique(vectors.terms)
    number = np.full(len(w), -1)
    number[local] = np.arange(len(local))
    vectors = Vectors(vectors.at, number[vectors.terms], vectors.values)
    tree = BallTree.of(vectors, len(local))
    scored = {node: (rows, Vectors(vectors.at, vectors.terms, exact).take(rows)) for node, rows in tree.leaves.items()}
    times = np.zeros(len(local), np.int64)
    for query in queries:
        terms = number[query.terms]
        here = terms >= 0
        if not here.any():
            continue
        terms = terms[here]
        times[terms] = query.times[here]
        bounds = tree.bounds(terms, query.times[here] * np.sqrt(w[local[terms]].astype(np.float64)))
        least = -query.best[-1][0] if len(query.best) == k else 1
        waiting = [(-float(bounds[0]), 0)]
        while waiting and -waiting[0][0] >= least:
            node = heapq.heappop(waiting)[1]
            if tree.children[node]:
                for child in tree.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(waiting, (-float(bounds[child]), child))
                continue
            rows, leaf = scored[node]
            scores = np.add.reduceat(leaf.values * times[leaf.terms], leaf.at[:-1])
            good = np.flatnonzero(scores >= least)
            if len(good):
                found = [(-s, ids[r] is None, ids[r]) for s, r in zip(scores[good].tolist(), rows[good].tolist())]
                query.best = heapq.nsmallest(k, query.best + found, key=_order)
                least = -query.best[-1][0] if len(query.best) == k else 1
        times[terms] = 0


def _order(found: tuple) -> tuple:
    return found[:2] if found[1] else found


def _search(batches: Iterable[pa.RecordBatch], shared, weights: Weights, k: int) -> Iterator[pa.RecordBatch]:
    item_kind, queries = shared.value
    queries = [Query(*q) for q in queries]
    root = np.sqrt(weights.w.astype(np.float64))
    parts: list[pa.RecordBatch] = []
    size = 0

    def search() -> None:
        n = np.concatenate([p["n"].to_numpy() for p in parts])
        lengths = np.concatenate([np.diff(p["terms"].offsets.to_numpy()) for p in parts])
        terms, tfs = (np.concatenate([p[name].flatten().to_numpy() for p in parts]) for name in ("terms", "tfs"))
        at = np.concatenate(([0], np.cumsum(lengths)))
        values = weights.values(np.repeat(n, lengths), tfs)
        ids = [x for p in parts for x in p["doc_id"].to_pylist()]
        _search_tree(Vectors(at, terms, values * root[terms]), values * weights.w[terms], ids, weights.w, queries, k)

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        parts.append(batch)
        size += len(batch["terms"].flatten())
        if size >= TREE:
            search()
            parts, size = [], 0
    if parts:
        search()
    rows = [(q.number, q.item_id, doc, -score) for q in queries for score, _, doc in q.best]
    numbers, items, docs, scores = zip(*rows) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(items, item_kind), pa.array(docs, kind), pa.array(scores, pa.int64())],
        names=["item", "item_id", "doc_id", "score"],
    )


# --- search --------------------------------------------------------------------------------------


def _of_block(docs: DataFrame, items: list[Row], kinds: tuple[str, str, pa.DataType], k: int) -> DataFrame | None:
    vocabulary: dict[bytes, int] = {}
    queries = []
    for number, row in enumerate(items):
        found = [vocabulary.setdefault(t, len(vocabulary)) for part in terms_of((row["text"] or "").encode()) for t in part]
        if found:
            terms, times = np.unique(np.array(found), return_counts=True)
            queries.append((number, row["item_id"], terms, times))
    if not queries:
        return None
    counts = term_counts(docs, vocabulary)
    weights = weigh(counts, len(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((kinds[2], queries))
    found = counts.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(
        lambda batches: _search(batches, shared, weights, k),
        f"item bigint, item_id {kinds[1]}, doc_id {kinds[0]}, score bigint",
    )
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents (``doc_id, text``) of the highest score for each item (``item_id, text``):
    ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII digits and letters and of non-ASCII characters; A-Z are lower-cased. A term's
    weight is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))`` over the ``N`` documents with terms, of which
    ``df`` have it; a document's value for a term is ``(10**9 tf) div (1000 tf + 8 m)`` with
    ``m = 25 + (75 n N) div L``, ``n`` being its terms and ``L`` those of all documents. The score adds up
    weight times value over the item's terms, repeated ones each time. Equal scores rank by ascending
    id, null ids last; rows of equal ids are ranked each. Only scores above 0 are returned.

    Null, empty and blank texts have no terms and are in no result; an item without terms has no rows.
    Each row of ``items`` is an item, also if its id is null or occurs again. No rows give no rows. Extra
    columns are ignored.

    Items are looked for in blocks of bounded size, each against all documents. A task makes trees of
    bounded size from the documents it reads, and goes on from tree to tree with the best documents that
    it has so far; what leaves it are ``k`` rows for each item.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], items.select("item_id").schema)
    kinds = (docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString(), empty.toArrow().schema.field(0).type)
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part = _of_block(docs, rows, kinds, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score bigint")
    return found
