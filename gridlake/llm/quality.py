"""Quality of texts by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import flat, pieces, raw_texts, stored, widened, with_columns

# Bounds of the training sample: documents of each label, and bytes of their whole texts.
MAX_DOCUMENTS = 1_000
MAX_BYTES = 32 << 20

# Filters look at so many bytes. Chunks of four blocks begin at every second block, so that each
# chunk shares half its bytes with the next.
WIDTH = 6
FILTERS = 16
EMBEDDING = 8
BLOCK = 128
CHUNK_BLOCKS, STEP_BLOCKS = 4, 2
# Blocks whose answers are held at once.
PIECE = 256


@dataclass
class Layout:
    """Texts one after another, each from the start of a block, and the blocks of all their chunks.

    Each text is followed by at least one window of zero bytes, up to the end of its last block.
    """

    padded: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray
    chunks: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        """Of the chunks of each text."""
        return np.cumsum(self.counts) - self.counts


def laid_out(data: np.ndarray, at: np.ndarray) -> Layout:
    lengths = np.diff(at)
    blocks = -(-(lengths + WIDTH) // BLOCK)
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * BLOCK + WIDTH - 1, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first * BLOCK - at[:-1], lengths)] = data
    counts = np.maximum(-(-(blocks - CHUNK_BLOCKS) // STEP_BLOCKS), 0) + 1
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, end = first[owner] + nth * STEP_BLOCKS, first[owner] + blocks[owner] - 1
    # A chunk that would reach over the end has its last block again.
    chunks = np.minimum(start[:, None] + np.arange(CHUNK_BLOCKS), end[:, None])
    return Layout(padded, first, lengths, counts, chunks)


@dataclass
class Model:
    """``table[k, byte]`` is what a byte at place k adds to each filter; chunks' largest answers are
    averaged over the document and weighed into the log-odds of label 1."""

    table: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Of every filter at every window of ``WIDTH`` bytes along the last axis, before the cut at 0."""
        n = data.shape[-1] - WIDTH + 1
        out = self.table[0][data[..., :n]]
        for k in range(1, WIDTH):
            out += self.table[k][data[..., k : k + n]]
        return out

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        """``pooled``: largest answers, averaged over chunks after shift and cut."""
        return pooled @ self.weights + self.bias

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each text of a batch. Every byte is looked at."""
        texts = laid_out(data, at)
        largest = np.vstack([some.max(axis=1) for some in self.block_answers(texts)])
        pooled = largest[texts.chunks[:, 0]]
        for k in range(1, CHUNK_BLOCKS):
            np.maximum(pooled, largest[texts.chunks[:, k]], out=pooled)
        pooled = np.maximum(pooled + self.shift, 0)
        sums = np.add.reduceat(pooled, texts.starts, axis=0)
        return 1 / (1 + np.exp(-self.log_odds(sums / texts.counts[:, None]).astype(float)))

    def block_answers(self, texts: Layout) -> Iterator[np.ndarray]:
        """Answers in all blocks, up to ``PIECE`` at a time; windows that begin after the end of a text don't count."""
        for start in range(0, len(texts.padded) // BLOCK, PIECE):
            n = min(PIECE, len(texts.padded) // BLOCK - start)
            data = texts.padded[start * BLOCK : (start + n) * BLOCK + WIDTH - 1]
            answers = self.answers(data).reshape(n, BLOCK, -1)
            numbers = np.arange(start, start + n)
            text = np.searchsorted(texts.first, numbers, "right") - 1
            # An empty text has one window.
            left = np.maximum(texts.lengths[text], 1) - (numbers - texts.first[text]) * BLOCK
            for k in np.flatnonzero(left < BLOCK):
                answers[k, max(left[k], 0) :] = -np.inf
            yield answers


def fit(
    parts: list[np.ndarray],
    labels: np.ndarray,
    weights: np.ndarray,
    epochs: int = 14,
    rate: float = 0.01,
) -> Model:
    """Train on all chunks of whole texts, given by their bytes, with ``labels`` and ``weights``, pooled as
    ``Model.scores`` does. Adam; the gradient of a largest answer goes to the bytes of its window."""
    rng = np.random.default_rng(5)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
        "filters": rng.normal(0, 0.5, (WIDTH, EMBEDDING, FILTERS)),
        "shift": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.3, FILTERS),
        "bias": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, f = 0, np.arange(FILTERS)
    for epoch in range(epochs):
        order = rng.permutation(len(parts))
        for some in np.array_split(order, max(1, len(order) // 32)):
            texts = laid_out(np.concatenate([parts[k] for k in some]), np.cumsum([0, *(len(parts[k]) for k in some)]))
            counts = texts.counts
            place = np.repeat(np.arange(len(some)), counts)
            table = np.einsum("be,kef->kbf", p["embed"], p["filters"]).astype(np.float32)
            model = Model(table, p["shift"], p["weights"], float(p["bias"][0]))
            largest, where = [], []
            for answers in model.block_answers(texts):
                where.append(answers.argmax(axis=1))
                largest.append(np.take_along_axis(answers, where[-1][:, None, :], axis=1)[:, 0])
            largest, where = np.vstack(largest), np.vstack(where)
            best = largest[texts.chunks].argmax(axis=1)
            block = np.take_along_axis(texts.chunks, best, axis=1)
            cut = largest[block, f] + p["shift"]
            window = block * BLOCK + where[block, f]
            pooled = np.add.reduceat(np.maximum(cut, 0), texts.starts, axis=0) / counts[:, None]
            y, z = labels[some], model.log_odds(pooled)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weights[some] / weights[some].sum()
            back = (slope / counts)[place][:, None] * p["weights"] * (cut > 0)
            d_table = np.zeros((WIDTH, 256, FILTERS))
            for k in range(WIDTH):
                cell = texts.padded[window + k].astype(np.int64) * FILTERS + f
                d_table[k] = np.bincount(cell.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            g = {
                "embed": np.einsum("kbf,kef->be", d_table, p["filters"]),
                "filters": np.einsum("be,kbf->kef", p["embed"], d_table),
                "shift": back.sum(axis=0),
                "weights": pooled.T @ slope + 1e-3 * p["weights"],
                "bias": np.array([slope.sum()]),
            }
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    table = np.einsum("be,kef->kbf", p["embed"], p["filters"]).astype(np.float32)
    return Model(table, p["shift"].astype(np.float32), p["weights"].astype(np.float32), float(p["bias"][0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    max_documents: int = MAX_DOCUMENTS,
    max_bytes: int = MAX_BYTES,
) -> Model | None:
    """Learn ``labels.quality`` (``doc_id, quality``) from texts of ``docs`` (``doc_id, text``).

    ``may_learn`` is a condition on ``doc_id`` for the rows that may be used. At most ``max_documents``
    of each label are used, in the order of a hash of the id, and of those the first whose texts have
    ``max_bytes`` together, but one at least; their whole texts are sent to the driver. Labels weigh as often
    as they occur.

    Null labels and ids are left out, and an id with several labels has the largest. With one label only
    the network still learns, and then always predicts it; without any it returns ``None``.
    """
    known = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    ids = None
    for label in sorted(counts):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
        ids = some if ids is None else ids.union(some)
    # At most max_documents ids of each label.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    texts = stored(texts.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")), "quality-sample")
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = texts.select("doc_id", "label", F.octet_length("text").cast("bigint").alias("size"))
    sizes = sizes.withColumn("total", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    taken = sizes.where((F.col("total") <= max_bytes) | (F.col("total") == F.col("size"))).select("doc_id")
    found = texts.join(F.broadcast(taken), "doc_id").toArrow()
    if found.num_rows == 0:
        return None
    found = found.sort_by("doc_id").combine_chunks()
    labels_of = np.array(found["label"].to_pylist(), float)
    parts = [np.frombuffer(raw, np.uint8) for chunk in found["text"].chunks for raw in raw_texts(chunk)]
    share = {k: counts[k] / max(1, int((labels_of == k).sum())) for k in counts}
    weights = np.array([share[int(k)] for k in labels_of])
    return fit(parts, labels_of, weights / weights.mean())


def _score(batches: Iterable[pa.RecordBatch], shared: Broadcast, name: str) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in pieces(batches, 1 << 20):
        scores = model.scores(*flat(batch["text"])) if model is not None else np.full(batch.num_rows, 0.5)
        yield with_columns(batch, [name], **{name: pa.array(scores, pa.float64())})


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole ``text`` under ``name``, between 0 and 1.

    A column of that name is replaced. A null or empty text is scored as one zero byte; without a model
    every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    return kept.mapInArrow(lambda batches: _score(batches, shared, name), widened(kept, **{name: "double"}))
