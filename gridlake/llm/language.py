"""Language of texts by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import flat, pieces, widened, with_columns

# Bounds of the training sample: documents of all and of one language. Every language has one at least.
MAX_DOCUMENTS = 8_000
MAX_PER_LANGUAGE = 400

# n-grams of 1 to 3 bytes are counted by a hash of this many bits.
HASH_BITS = 13
# Parts of each language that are looked through apart for the sample.
SALTS = 64
# Texts whose histograms are made at once.
_GROUP = 64

UNDEFINED = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages, far from each other; no column is constant."""
    bits = 1 if n < 3 else max(15, int(np.ceil(10 * np.log2(n))))
    rng = np.random.default_rng(seed)
    best, distance = None, -1
    # The distances of many languages take long, and random codewords are far apart for these.
    for _ in range(max(1, min(200, 200 * 256**2 // (n * n)))):
        code = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        if n > 1:
            for k in np.flatnonzero(np.abs(code.sum(axis=0)) == n):
                code[rng.integers(n), k] *= -1
        apart = (bits - code @ code.T) // 2 + np.eye(n, dtype=int) * bits
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best.astype(np.float32)


def histograms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text a row of square roots of shares of hashed n-grams, of length 1.

    A-Z are lower-cased; n-grams do not reach over the end of a text.
    """
    size = 1 << HASH_BITS
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    lengths = np.diff(at)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    left = np.repeat(at[1:], lengths) - np.arange(at[0], at[-1])
    counts = np.zeros(len(lengths) * size, np.float32)
    code = np.zeros(len(lower), np.uint32)
    for n in (1, 2, 3):
        # The n-gram that begins at each byte, while it fits.
        code = code[: len(lower) - n + 1] * np.uint32(257) + lower[n - 1 :] + np.uint32(n)
        if len(code) == 0:
            break
        cell = ((code * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        fits = left[: len(code)] >= n
        cell += owner[: len(code)] * size
        counts += np.bincount(cell[fits], minlength=len(counts)).astype(np.float32)
    rows = np.sqrt(counts.reshape(len(lengths), size))
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def grouped(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Histograms of all texts, some at a time."""
    for start in range(0, len(at) - 1, _GROUP):
        some = at[start : start + _GROUP + 1]
        yield histograms(data[some[0] : some[-1]], some - some[0])


@dataclass
class Model:
    """Linear classifiers of the bits; ``trust`` weighs each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float

    def losses(self, rows: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword for each row of features."""
        outputs = rows @ self.weights + self.bias
        ones, zeros = self.trust * (self.code > 0), self.trust * (self.code < 0)
        return np.logaddexp(0, -outputs) @ ones.T + np.logaddexp(0, outputs) @ zeros.T

    def chances(self, rows: np.ndarray) -> np.ndarray:
        losses = -self.sharpness * self.losses(rows)
        odds = np.exp(losses - losses.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def fit(rows: np.ndarray, kinds: np.ndarray, languages: list[str], epochs: int = 30, rate: float = 0.02) -> Model:
    """Logistic classifiers of all code bits at once, by Adam in mini-batches."""
    code = codewords(len(languages))
    # Languages weigh the same, however many texts they have.
    share = 1.0 / np.maximum(np.bincount(kinds, minlength=len(languages)), 1)
    weight = (share[kinds] / share[kinds].mean()).astype(np.float32)
    rng = np.random.default_rng(3)
    w = np.zeros((rows.shape[1] + 1, code.shape[1]), np.float32)
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 128):
            some = order[start : start + 128]
            x = np.hstack([rows[some], np.ones((len(some), 1), np.float32)])
            sign = code[kinds[some]]
            slope = -sign / (1 + np.exp(np.clip(sign * (x @ w), -30, 30))) * weight[some, None]
            g = x.T @ slope / len(some) + 1e-5 * w
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    right = (rows @ w[:-1] + w[-1]) * code[kinds] > 0
    trust = np.stack([right[kinds == k].mean(axis=0) if (kinds == k).any() else np.ones(code.shape[1]) for k in range(len(languages))])
    trust = np.maximum(trust, 1e-3)
    trust /= trust.sum(axis=1, keepdims=True)
    return Model(languages, code, w[:-1], w[-1], trust.astype(np.float32), 4.0)


def _sample_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        cells, shares = [], []
        for rows in grouped(*flat(batch["text"])):
            for row in rows:
                present = np.flatnonzero(row)
                cells.append(present.astype(np.int32))
                shares.append(row[present])
        yield pa.RecordBatch.from_arrays(
            [batch["lang"], pa.array(cells, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            names=["lang", "cells", "shares"],
        )


def train(
    docs: DataFrame,
    may_learn: Column,
    max_documents: int = MAX_DOCUMENTS,
    max_per_language: int = MAX_PER_LANGUAGE,
) -> Model | None:
    """Learn ``lang`` from ``text`` of the rows of ``docs`` (``doc_id, text, lang``) that meet ``may_learn``.

    Every language is learned, from a sample of at most ``max_per_language`` documents, and at most
    ``max_documents`` in all or one of each language, whichever is more, chosen by a hash of the id; whole
    texts are used, and the driver gets their histograms. Null languages and ids, and texts that are null
    or empty, teach nothing. Of rows of equal id and language the text of the least hash is used. Returns
    ``None`` if there is nothing to learn from.
    """
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(F.length("text") > 0)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    each = max(1, min(max_per_language, max_documents // len(languages)))
    hashed = F.xxhash64("doc_id")
    ids = known.select("doc_id", "lang", F.pmod(hashed, F.lit(SALTS)).alias("salt")).distinct()
    # The first of each part and then the first of these, so that no task gets all of one language.
    for part in (["lang", "salt"], ["lang"]):
        turn = F.row_number().over(Window.partitionBy(*part).orderBy(hashed, "doc_id"))
        ids = ids.withColumn("turn", turn).where(F.col("turn") <= each).drop("turn")
    # At most max_documents ids, or one of each language.
    texts = known.select("doc_id", "text", "lang").join(F.broadcast(ids.drop("salt")), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    texts = texts.select("text", "lang")
    found = texts.mapInArrow(_sample_rows, "lang string, cells array<int>, shares array<float>").toArrow()
    cells, shares = found["cells"].combine_chunks(), found["shares"].combine_chunks()
    rows = np.zeros((len(cells), 1 << HASH_BITS), np.float32)
    owner = np.repeat(np.arange(len(cells)), np.diff(np.asarray(cells.offsets)))
    rows[owner, np.asarray(cells.flatten())] = np.asarray(shares.flatten())
    number = {name: k for k, name in enumerate(languages)}
    kinds = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
    order = np.lexsort((rows.sum(axis=1), kinds))  # whatever order the rows came in
    return fit(rows[order], kinds[order], languages)


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode(errors="replace")))


def _predict(batches: Iterable[pa.RecordBatch], shared: Broadcast, ambiguous_below: float) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in pieces(batches, 1 << 20):
        data, at = flat(batch["text"])
        chances = (
            np.vstack([model.chances(rows) for rows in grouped(data, at)])
            if model is not None and batch.num_rows
            else np.zeros((batch.num_rows, 0))
        )
        raw, ends = data.tobytes(), at.tolist()
        names, scores, unclear = [], [], []
        for k, chance in enumerate(chances):
            if len(chance) == 0 or not has_letter(raw[ends[k] : ends[k + 1]]):
                names.append(UNDEFINED), scores.append(0.0), unclear.append(True)
                continue
            best = int(chance.argmax())
            second = float(np.partition(chance, -2)[-2]) if len(chance) > 1 else 0.0
            names.append(model.languages[best])
            scores.append(min(1.0, float(chance[best])))
            unclear.append(float(chance[best]) - second < ambiguous_below)
        new = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "ambiguous": pa.array(unclear, pa.bool_())}
        yield with_columns(batch, ["text", *new], **new)


def predict(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.2) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``lang_pred, score, ambiguous``; such columns are replaced.

    The prediction is the language whose codeword the classifiers' outputs are nearest to, by weighted
    loss. ``score`` is its share among all languages, and ``ambiguous`` tells that the next one's share is
    less than ``ambiguous_below`` below it. A text that is null or has no letters, and any text if
    nothing was learned, is ``und`` with score 0, and ambiguous.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "ambiguous"]
    rows = docs.drop(*new)
    schema = widened(rows, ["text"], lang_pred="string", score="double", ambiguous="boolean")
    return rows.mapInArrow(lambda batches: _predict(batches, shared, ambiguous_below), schema)
