import math
import re
from collections import Counter

import numpy as np
import pytest
from samples import ROWS, fold, frame, table
from pyspark.sql import functions as F

from gridlake.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    counts = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        wanted = Counter(TERM.findall(fold(text)))
        scores = []
        for i, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(x * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bounds_hold_for_all_below():
    rng = np.random.default_rng(3)
    width = 60
    sizes = rng.integers(1, 12, 500)
    at = np.concatenate(([0], np.cumsum(sizes)))
    terms = np.concatenate([rng.choice(width, s, replace=False) for s in sizes])
    vectors = rs.Vectors(at, terms, rng.random(at[-1]) * 10.0 ** rng.integers(0, 7, at[-1]))
    vectors.values[: at[40]] = np.tile(vectors.values[: at[1]], at[40])[: at[40]]
    tree = rs.BallTree.of(vectors, width, leaf=8)
    assert sorted(np.concatenate(list(tree.leaves.values())).tolist()) == list(range(500))

    def below(node):
        return tree.leaves[node] if tree.children[node] is None else np.concatenate([below(c) for c in tree.children[node]])

    for _ in range(20):
        some = rng.choice(width, 7, replace=False)
        q = rng.random(7) * 100
        dense = np.zeros(width)
        dense[some] = q
        inner = vectors.dot(dense)
        for node, bound in enumerate(tree.bounds(some, q)):
            assert inner[below(node)].max() <= bound


@pytest.mark.parametrize("tree, block", [(1 << 20, 1 << 22), (200, 1 << 22), (1000, 2000)])
def test_whole_table(spark, monkeypatch, tree, block):
    monkeypatch.setattr(rs, "TREE", tree)
    monkeypatch.setattr(rs, "ITEM_BYTES", block)
    docs = [(d["doc_id"], d["text"]) for d in table("documents")]
    items = [(b["item_id"], b["text"]) for b in table("benchmark")]
    assert rows(rs.search(*frames(spark, docs, items))) == brute(docs, items)


def test_odd_rows(spark):
    items = [(1, "quick brown fox"), (2, None), (3, ""), (None, "ÜBER größe 漢字 lazy dog"), (4, "w5x5 w5x5 w6x6 one"), (5, "!? none-at-all zz"), (1, "quick brown fox")]
    docs = [(r[0], r[1]) for r in ROWS]
    names = {c: F.lit("x") for c in ("score", "rank", "item", "item_id", "n")}
    found = rs.search(frame(spark).withColumns(names), frames(spark, [], items)[1].withColumn("score", F.lit(1)))
    assert rows(found) == brute(docs, items)
    for left, right in (([], items), (docs, []), ([], []), (docs, [(1, None)]), ([(1, None), (2, " ")], items)):
        assert rows(rs.search(*frames(spark, left, right))) == []


def test_ties_rank_by_id(spark):
    docs = [(30 - k, "same words here") for k in range(25)] + [(None, "same words here"), (99, "other")]
    items = [(1, "words"), (2, "Same words, same words")]
    assert rows(rs.search(*frames(spark, docs, items))) == brute(docs, items)


def test_tree_leaves_out_what_is_far():
    """Groups of like documents: most leaves cannot reach the best score."""
    rng = np.random.default_rng(4)
    topics = [np.sort(rng.choice(2000, 12, replace=False)) for _ in range(40)]
    parts = [topics[d % 40] for d in range(4000)]
    at = np.arange(0, 12 * 4000 + 1, 12)
    values = 1 + 0.1 * rng.random(at[-1])
    tree = rs.BallTree.of(rs.Vectors(at, np.concatenate(parts), values), 2000)
    bounds = tree.bounds(topics[7], np.ones(12))
    assert (bounds[list(tree.leaves)] >= 12).mean() < 0.25
