import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import ROWS, frame, table, words

from gridlake.llm import ppm


def brute_model(texts, order):
    follow = defaultdict(Counter)
    for text in texts:
        x = [*ppm_bytes(text), 256]
        for t, s in enumerate(x):
            for k in range(min(order, t) + 1):
                follow[tuple(x[t - k : t])][s] += 1
    return follow


def ppm_bytes(text):
    return (text or "").encode().lower()


def brute_score(text, follow, order):
    x, total = [*ppm_bytes(text), 256], 0.0
    for t, s in enumerate(x):
        out = set()
        for k in range(min(order, t), -1, -1):
            counts = {a: n for a, n in follow.get(tuple(x[t - k : t]), {}).items() if a not in out}
            if not counts:
                continue
            n = sum(counts.values())
            if s in counts:
                total += math.log10((2 * counts[s] - 1) / (2 * n))
                break
            total += math.log10(len(counts) / (2 * n))
            out |= counts.keys()
        else:
            total -= math.log10(257 - len(out))
    return total


def brute(rows, learn, order):
    train = [r for r in rows if learn(r[0])]
    follow = brute_model([r[1] for r in train], order)
    tokens = Counter(w for r in train for w in [*words_ascii(r[1]), ""])
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for i, text in rows:
        own = [*words_ascii(text), ""]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, len(own), sum(tokens[w] > 0 for w in own), n, round(base, 6), round(brute_score(text, follow, order), 6)))
    return out


def words_ascii(text):
    return words(text)


def rounded(df):
    return [
        (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
        for r in df.collect()
    ]


@pytest.mark.parametrize("order, size", [(1, 1 << 20), (3, 4000), (5, 4000)])
def test_table(spark, order, size):
    rows = [(d["doc_id"], d["text"]) for d in table("documents") if len(d["text"]) < 1500][:60]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rounded(ppm.score(df, F.col("doc_id") % 5 != 1, order=order, chunk_bytes=size))
    assert sorted(got) == sorted(brute(rows, lambda i: i % 5 != 1, order))


def test_odd_rows(spark):
    short = [r for r in ROWS if len(r[1] or "") < 1000]
    got = rounded(ppm.score(frame(spark, short), F.coalesce(F.col("doc_id"), F.lit(0)) != 6))
    want = brute([(r[0], r[1]) for r in short], lambda i: i != 6, 5)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_text_nothing_to_learn_and_no_rows(spark):
    assert ppm.score(frame(spark), F.lit(True)).count() == len(ROWS)
    rows = rounded(ppm.score(frame(spark, ROWS[:4]), F.lit(False)))
    assert {r[3] for r in rows} == {0} and {r[4] for r in rows} == {0.0}
    assert sorted(r[5] for r in rows)[-1] == round(-math.log10(257), 6)
    assert ppm.score(frame(spark, []), F.lit(True)).collect() == []


def test_chances_add_up_to_one():
    texts = [b"abracadabra", b"abcab", b"banana"]
    follow = brute_model([t.decode() for t in texts], 3)
    packed = {sum(s << (ppm.SHIFT * k) for k, s in enumerate(reversed(c))) + (1 << (ppm.SHIFT * len(c))): f for c, f in follow.items()}
    contexts = np.array(list(packed))
    pairs = [sorted(f.items()) for f in packed.values()]
    model = ppm.Model(
        contexts,
        np.array([len(x) for x in pairs]),
        np.array([s for x in pairs for s, _ in x]),
        np.array([n for x in pairs for _, n in x]),
    )
    for start in (b"", b"a", b"abr", b"zzz", b"ban"):
        # Each byte after the start, and its end.
        tails = [start + bytes([s]) for s in range(256) if not 65 <= s <= 90]
        windows = ppm.Windows(np.frombuffer(b"".join(tails), np.uint8), np.arange(len(tails) + 1) * (len(start) + 1), 3)
        chances = 10 ** model.log_chances(windows)[windows.number].reshape(len(tails), -1)
        ends = ppm.Windows(np.frombuffer(start, np.uint8), np.array([0, len(start)]), 3)
        capitals = 26 * chances[tails.index(start + b"\x00"), len(start)]
        total = chances[:, len(start)].sum() + capitals + 10 ** model.log_chances(ends)[ends.number][-1]
        assert abs(total - 1) < 1e-9


def test_windows_count_sequences():
    texts = [b"abracadabra", b"", b"ABcab", "é漢".encode() * 3, bytes(range(128, 256)) + bytes(range(32))]
    at = np.cumsum([0, *map(len, texts)])
    windows = ppm.Windows(np.frombuffer(b"".join(texts), np.uint8), at, 5)
    learned = np.repeat(np.array([1, 1, 0, 1, 1], bool), np.diff(at) + 1)
    keys, counts = ppm._merged(*[[x] for x in windows.sequences(learned)])
    want = Counter()
    for text, known in zip(texts, (1, 1, 0, 1, 1)):
        x = [*text.lower(), 256]
        for t in range(len(x)):
            for n in range(1, min(6, t + 1) + 1):
                want[sum(s << (ppm.SHIFT * k) for k, s in enumerate(reversed(x[t - n + 1 : t + 1]))) + (1 << (ppm.SHIFT * n))] += known
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(want)
