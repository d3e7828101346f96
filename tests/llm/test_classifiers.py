"""Toxicity, language and quality: held-out accuracy, and cases that must not break."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import ROWS, frame, remainder

from gridlake.llm import language, quality, toxicity
from gridlake.llm.common import read
from gridlake.llm.common import remainder as fold_of
from gridlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}


def held_out(spark, name, modulus, rest):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (remainder(r["doc_id"], modulus) == rest) and 0 <= r["score"] <= 1 for r in rows)
    return [r for r in rows if r["held_out"]]


def test_toxicity(spark, labels):
    rows = [r for r in held_out(spark, "op5_toxicity", 3, 1) if r["doc_id"] in labels]
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    right = [r["predicted"] == labels[r["doc_id"]]["toxic"] for r in rows]
    assert np.mean(right) > 0.93
    caught = [r["predicted"] for r in rows if labels[r["doc_id"]]["toxic"]]
    assert np.mean(caught) > 0.5


def test_quality(spark, labels):
    rows = [r for r in held_out(spark, "op9_quality", 5, 0) if r["doc_id"] in labels]
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["quality"] for r in rows]) > 0.9


def test_language(spark):
    truth = {r["doc_id"]: r["lang"] for r in read(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = held_out(spark, "op6_language", 3, 1)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.98


def test_nnpu_separates_what_only_positives_have():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 30)) < 0.3).astype(np.float32)
    y = x[:, 0] == 1
    w, b = toxicity.fit_nnpu(x[y][:500], x[500:], float(y.mean()))
    assert ((x @ w + b > 0) == y).mean() > 0.97


def test_codewords():
    for n in (1, 2, 4, 30):
        code = language.codewords(n)
        assert len({tuple(row) for row in code}) == n
        assert n == 1 or all(len(set(column)) == 2 for column in code.T)


def brute_prediction(model, text):
    """Loss-weighted decoding, one language and one bit at a time."""
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0, 0.0
    raw = (text or "").encode()
    row = language.histograms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].astype(float)
    losses = []
    for k in range(len(model.languages)):
        loss = 0.0
        for bit in range(model.code.shape[1]):
            margin = (row @ model.weights[:, bit] + model.bias[bit]) * model.code[k, bit]
            loss += model.trust[k, bit] * np.log1p(np.exp(-margin))
        losses.append(loss)
    odds = np.exp(-model.sharpness * np.array(losses))
    shares = odds / odds.sum()
    first, second = np.sort(shares)[::-1][:2] if len(shares) > 1 else (shares[0], 0.0)
    return model.languages[int(shares.argmax())], first, first - second


def test_predictions_by_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language.train(docs, fold_of("doc_id", 3) != 1)
    extra = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 - 3", None), (-4, "é", None)], docs.schema)
    docs = docs.unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        name, score, ahead = brute_prediction(model, texts[r["doc_id"]])
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-4
        assert r["ambiguous"] == (ahead < 0.2) or abs(ahead - 0.2) < 1e-3


def test_more_than_256_languages_are_learned(spark):
    rng = np.random.default_rng(6)
    rows, word = [], lambda: "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 7))
    for k in range(300):
        own = [word() for _ in range(4)]
        rows += [(4 * k + n, " ".join(rng.permutation(own * 6)), f"l{k:03}") for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, F.col("doc_id") % 4 != 3)
    assert len(model.languages) == 300
    found = language.predict(docs.where("doc_id % 4 = 3"), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.9


def test_language_learns_the_same_of_equal_ids(spark):
    rows = [(k % 10, f"{'abc' if k % 2 else 'xyz'} text {k}", "a" if k % 2 else "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    first, second = (language.train(df, F.lit(True)) for df in (docs, docs.orderBy(F.desc("text")).repartition(7)))
    assert np.array_equal(first.weights, second.weights)


def test_histograms_stay_within_texts():
    parts = [b"", b"a", b"ab", "Größe ABC".encode(), b"xyz" * 100]
    at = np.cumsum([0, *map(len, parts)])
    together = language.histograms(np.frombuffer(b"".join(parts), np.uint8), at)
    for row, part in zip(together, parts):
        alone = language.histograms(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0]
        assert np.allclose(row, alone)


def test_network_sees_every_window():
    rng = np.random.default_rng(1)
    w = quality.WIDTH
    model = quality.Model(rng.normal(size=(w, 256, 4)).astype(np.float32), np.zeros(4), rng.normal(size=4), 0.1)
    parts = [b"", b"a", bytes(range(130)), rng.integers(0, 256, 4000, np.uint8).tobytes(), b"z" * 1024]
    got = model.scores(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    for score, part in zip(got, parts):
        n = max(1, len(part))
        padded = np.frombuffer(part + bytes(w), np.uint8)
        answers = np.array([sum(model.table[k][padded[t + k]] for k in range(w)) for t in range(n)])
        blocks = -(-(len(part) + w) // quality.BLOCK)
        starts = range(0, max(blocks - quality.CHUNK_BLOCKS, 0) + 1, quality.STEP_BLOCKS)
        starts = [*starts, *([starts[-1] + quality.STEP_BLOCKS] if starts[-1] + quality.CHUNK_BLOCKS < blocks else [])]
        pooled = []
        for s in starts:
            inside = answers[s * quality.BLOCK : (s + quality.CHUNK_BLOCKS) * quality.BLOCK]
            pooled.append(np.maximum(inside.max(axis=0), 0) if len(inside) else np.zeros(4))
        z = np.mean(pooled, axis=0) @ model.weights + model.bias
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_odd_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (7, 1, 1), (8, None, None), (None, 1, 1), (10, 0, 0), (99, 0, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    some = F.lit(True)
    toxic = toxicity.with_score(docs, toxicity.train(docs, labels, some))
    good = quality.with_score(docs, quality.train(docs, labels, some))
    spoken = language.predict(docs, language.train(docs, some))
    for df in (toxic, good, spoken):
        rows = df.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["lang_pred"] for r in spoken.collect()}
    assert {found[k] for k in (2, 3, 4)} == {"und"}
    assert toxicity.drop_toxic(docs, toxicity.train(docs, labels, some)).columns == docs.columns


def test_nothing_to_learn(spark):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = F.lit(True)
    assert {r["score"] for r in toxicity.with_score(docs, toxicity.train(docs, none, some)).collect()} == {0.0}
    assert {r["score"] for r in quality.with_score(docs, quality.train(docs, none, some)).collect()} == {0.5}
    model = language.train(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}
    empty = frame(spark, [])
    assert language.predict(empty, language.train(docs, some)).collect() == []
    assert quality.with_score(empty, None).collect() == []


def test_quality_learns_from_whole_texts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        text = bytearray(rng.integers(97, 123, 8192, np.uint8).tobytes())
        at = int(rng.integers(560, 640))
        text[at : at + 700] = (b"0123456789" if k % 2 else b"9753186420") * 70
        rows.append((k, text.decode(), k % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = docs.select("doc_id", "quality")
    model = quality.train(docs, labels, F.col("doc_id") < 200)
    found = quality.with_score(docs.where("doc_id >= 200"), model).collect()
    assert np.mean([(r["score"] > 0.5) == r["quality"] for r in found]) > 0.9


def test_quality_bounds_the_sample_by_bytes_of_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda parts, labels, weights: seen.append((parts, labels)))
    docs = spark.createDataFrame([(k, chr(97 + k) * 5000) for k in range(20)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality")
    for most in (17_000, 100):
        quality.train(docs, labels, F.lit(True), max_bytes=most)
    for (parts, kinds), each in zip(seen, (3, 1)):
        assert sorted(kinds) == [0] * each + [1] * each
        assert all(len(x) == 5000 and len(set(x.tolist())) == 1 for x in parts)
