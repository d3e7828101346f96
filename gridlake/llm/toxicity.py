"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import pieces, raw_texts, stored, unused, widened, with_columns
from gridlake.llm.decontamination import words_of

# Bounds of the training sample and of what is learned from it.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
MAX_FEATURES = 512


# Prefixes of words, in bytes, that are features.
PREFIX = range(3, 13)
# A part of words that occurs so often in a text makes one more feature.
LEVELS = (2, 4, 8)
# Words whose features a task remembers; then it starts anew.
MAX_WORDS = 300_000
# A feature is in so many documents of the sample at least, and tells the kinds apart so surely.
MIN_DOCUMENTS, MIN_Z = 5, 4.0


def parts_of(word: bytes) -> list[bytes]:
    """The word, and each shorter beginning of it with a star."""
    return [word, *[word[:k] + b"*" for k in PREFIX if k < len(word)]]


def features_of(text: bytes) -> set[bytes]:
    """Parts of the words of a text, and for those that occur often how often at least."""
    counts: Counter[bytes] = Counter()
    for word, n in Counter(words_of(text)).items():
        for part in parts_of(word):
            counts[part] += n
    often = {b"%b@%d" % (part, level) for part, n in counts.items() if n > 1 for level in LEVELS if n >= level}
    return often | counts.keys()


class Finder:
    """Numbers of the known features of texts."""

    def __init__(self, features: list[bytes]):
        self.levels: dict[bytes, list[tuple[int, int]]] = {}
        for k, feature in enumerate(features):
            part, _, level = feature.partition(b"@")
            self.levels.setdefault(part, []).append((int(level or 1), k))
        self.words: dict[bytes, tuple[bytes, ...]] = {}

    def _look(self, word: bytes) -> tuple[bytes, ...]:
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        found = tuple(part for part in parts_of(word) if part in self.levels)
        self.words[word] = found
        return found

    def find(self, text: bytes) -> list[int]:
        known, counts = self.words.get, {}
        for word in words_of(text):
            parts = known(word)
            if parts is None:
                parts = self._look(word)
            for part in parts:
                counts[part] = counts.get(part, 0) + 1
        return sorted(k for part, n in counts.items() for level, k in self.levels[part] if n >= level)


@dataclass
class Model:
    """Log-odds of the label: a bias and the weight of each feature that occurs."""

    bias: float
    features: list[bytes]
    weights: np.ndarray

    def score(self, numbers: list[int]) -> float:
        z = self.bias + float(self.weights[numbers].sum())
        return 0.0 if z == -np.inf else float(1.0 / (1.0 + np.exp(-z)))


def _loss(z: np.ndarray) -> float:
    """Mean logistic loss of margins."""
    return float(np.logaddexp(0.0, -z).mean())


def _slope(z: np.ndarray) -> np.ndarray:
    """Derivative of the mean logistic loss by each margin."""
    return -1.0 / (1.0 + np.exp(z)) / len(z)


def fit_nnpu(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    steps: int = 800,
    rate: float = 0.05,
    decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier from positive and unlabelled rows of features.

    The risk is prior * R(positive, +1) + max(0, R(unlabelled, -1) - prior * R(positive, -1)): what
    unlabelled rows say of the negative class is corrected by the share ``prior`` of positive rows
    among them, and where that correction turns negative, which only fitting by heart can do, it counts
    as 0. Adam, on all rows at each step.
    """
    w, b = np.zeros(positive.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        as_positive, as_negative = _slope(zp), -_slope(-zp)
        of_unlabelled = -_slope(-zu)
        if _loss(-zu) - prior * _loss(-zp) >= 0:
            gp, gu = prior * (as_positive - as_negative), of_unlabelled
        else:
            gp, gu = prior * as_positive, 0 * of_unlabelled
        g = np.append(positive.T @ gp + unlabelled.T @ gu + decay * w, gp.sum() + gu.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), float(b - move[-1])
    return w, b


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and other documents of a piece each feature is."""
    for batch in pieces(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for raw, positive in zip(raw_texts(batch["text"]), batch["positive"].to_pylist()):
            counts[positive].update(features_of(raw))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.binary()),
                pa.array([counts[1][f] for f in names], pa.int64()),
                pa.array([counts[0][f] for f in names], pa.int64()),
            ],
            names=["feature", "p", "u"],
        )


def _telling(counts: DataFrame, n_p: int, n_u: int, most: int) -> list[bytes]:
    """The features whose share of documents differs most surely between both kinds."""
    sums = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u") + 1) / F.lit(n_p + n_u + 2.0)
    apart = (F.col("p") + 0.5) / F.lit(n_p + 1.0) - (F.col("u") + 0.5) / F.lit(n_u + 1.0)
    z = F.abs(apart) / F.sqrt(share * (1 - share) * F.lit(1 / n_p + 1 / n_u))
    sure = sums.where(F.col("p") + F.col("u") >= MIN_DOCUMENTS).withColumn("z", z).where(F.col("z") > MIN_Z)
    chosen = sure.orderBy(F.desc("z"), "feature").limit(most).collect()
    return sorted(bytes(r["feature"]) for r in chosen)


def _rows(batches: Iterable[pa.RecordBatch], features: Broadcast) -> Iterator[pa.RecordBatch]:
    finder = Finder(features.value)
    for batch in pieces(batches):
        found = [finder.find(raw) for raw in raw_texts(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [batch["positive"], batch["unlabelled"], pa.array(found, pa.list_(pa.int32()))],
            names=["positive", "unlabelled", "found"],
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Learn ``labels.toxic`` (``doc_id, toxic``) from texts of ``docs`` (``doc_id, text``).

    ``may_learn`` is a condition on ``doc_id`` for the rows that may be used. Confirmed examples are
    those labelled 1; every other document counts as unlabelled, whatever its label. At most
    ``max_positive`` and ``max_unlabelled`` are used, chosen by a hash of the id, with their whole
    texts; the driver gets which features each of them has. The class prior is the share of 1 among
    labels. Features are the words and beginnings of words, ``max_features`` at most, that tell confirmed
    and other documents apart.

    Null labels and ids are left out; an id with several labels is positive if one of them is. Of rows of
    equal ids the text of the least hash is used. Without
    a confirmed or without an unlabelled example the model knows only the prior (0 without labels).
    """
    labelled = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    labelled = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = labelled.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not ones:
        return Model(-np.inf, [], np.zeros(0))
    prior = min(max(ones / n, 1e-4), 1 - 1e-4)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labelled.where("toxic = 1").select("doc_id").orderBy(*order).limit(max_positive)
    others = docs.where(may_learn & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    others = others.orderBy(*order).limit(max_unlabelled)
    sample = chosen.select("doc_id", F.lit(True).alias("positive")).union(
        others.select("doc_id", F.lit(False).alias("positive"))
    )
    kinds = sample.groupBy("doc_id").agg(F.max("positive").alias("positive"), (~F.min("positive")).alias("unlabelled"))
    # At most max_positive + max_unlabelled ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(kinds), "doc_id").groupBy("doc_id", "positive", "unlabelled")
    texts = texts.agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    texts = stored(texts.select("text", "positive", "unlabelled"), "toxicity-sample")
    n_p, n_u = texts.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not n_p or not n_u:
        return Model(float(np.log(prior / (1 - prior))), [], np.zeros(0))
    counts = texts.select("text", "positive").mapInArrow(_count_features, "feature binary, p bigint, u bigint")
    features = _telling(counts, n_p, n_u, max_features)
    shared = docs.sparkSession.sparkContext.broadcast(features)
    kind = "positive boolean, unlabelled boolean, found array<int>"
    rows = texts.mapInArrow(lambda batches: _rows(batches, shared), kind).toArrow()
    found = rows["found"].combine_chunks()
    x = np.zeros((len(found), len(features)), np.float32)
    x[np.repeat(np.arange(len(found)), np.diff(np.asarray(found.offsets))), np.asarray(found.flatten())] = 1
    positive, unlabelled = (np.array(rows[k].to_pylist(), bool) for k in ("positive", "unlabelled"))
    w, b = fit_nnpu(x[positive], x[unlabelled], prior)
    return Model(b, features, w)


def _score(batches: Iterable[pa.RecordBatch], model: Broadcast, name: str) -> Iterator[pa.RecordBatch]:
    known = model.value
    finder = Finder(known.features)
    for batch in pieces(batches):
        scores = [known.score(finder.find(raw)) for raw in raw_texts(batch["text"])]
        yield with_columns(batch, [name], **{name: pa.array(scores, pa.float64())})


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole ``text`` under ``name``, between 0 and 1.

    A column of that name is replaced. A null or empty text has no words and gets the score of that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    schema = widened(kept, **{name: "double"})
    return kept.mapInArrow(lambda batches: _score(batches, shared, name), schema)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, as they are."""
    name = unused(docs, "score")
    return with_score(docs, model, name).where(F.col(name) < limit).select(*docs.columns)
