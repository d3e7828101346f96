import re

import pytest
from samples import LONG, ROWS, WORDS, fold, frame, table

from gridlake.llm.decontamination import drop_contaminated, find_contamination, is_contaminated, n_hit, remove_spans


def brute(texts, items, n=13):
    """Number of words, hit positions and items of each text."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    out = []
    for text in texts:
        w = find(text)
        hit, names = set(), set()
        for item, t in items:
            v = find(t)
            m = min(n, len(v))
            grams = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    if item is not None:
                        names.add(str(item))
        out.append((len(w), sorted(hit), sorted(names)))
    return out


ITEMS = [
    (1, " ".join(WORDS)),
    (2, "two LINES"),
    (3, None),
    (4, " .,; "),
    (None, "World"),
    (5, LONG[:400]),
    (2, "two lines"),
    (10, "größe UND école"),
]


def flat_spans(spans):
    return [k for s in spans for k in range(s["start"], s["end"])]


@pytest.mark.parametrize("size", [1 << 20, 150])
def test_finds(spark, size):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = find_contamination(frame(spark), items, max_item_bytes=size)
    got = [(r["doc_id"], r["n_words"], flat_spans(r["spans"]), r["items"]) for r in found.collect()]
    want = [(r[0], *b) for r, b in zip(ROWS, brute([r[1] for r in ROWS], ITEMS))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_removal(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = frame(spark)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    want = [r for r, (n, hit, _) in zip(ROWS, brute([r[1] for r in ROWS], ITEMS)) if not (hit and 20 * len(hit) >= n)]
    assert sorted((tuple(r) for r in kept.select("doc_id", "text", "lang", "source").collect()), key=str) == sorted(want, key=str)
    cut = {r["doc_id"]: r["text"] for r in remove_spans(docs, items).where("doc_id in (1, 2, 8)").collect()}
    assert cut == {1: "Hello, . It's FINE;\t\nhere", 2: None, 8: ""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    found = find_contamination(frame(spark), none)
    assert found.where(n_hit("spans") > 0).count() == 0 and found.count() == len(ROWS)
    assert found.where(is_contaminated("n_words", "spans")).count() == 0
    assert find_contamination(frame(spark, []), none).collect() == []


def test_items_of_the_tables(spark):
    docs, items = table("documents")[:60], [(r["item_id"], r["text"]) for r in table("benchmark")]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    found = find_contamination(df, spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r["doc_id"]: (r["n_words"], flat_spans(r["spans"]), r["items"]) for r in found.collect()}
    assert got == {d["doc_id"]: b for d, b in zip(docs, brute([d["text"] for d in docs], items))}
