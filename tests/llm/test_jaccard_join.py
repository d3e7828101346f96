import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import LONG, ROWS, WORDS, frame, table, words

from gridlake.llm import jaccard_join as jj


def brute_sets(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=80):
    """Size and smallest id in reach of each (id, text), and the linked pairs of different sets."""
    sets = [frozenset(brute_sets(t)) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    pairs = set()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                pairs.add(frozenset((a, b)))
                root[find(a)] = find(b)
    first = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            key = find(s)
            first[key] = min(i, first.get(key, i))
    return [(i, len(s), first.get(find(s)) if s else i) for (i, _), s in zip(rows, sets)], pairs


def edited_texts():
    """Groups of texts with few and more words changed, chains, shared passages and short texts."""
    rng = np.random.default_rng(5)
    passage = [f"shared{k}" for k in range(40)]
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.integers(50)}" for _ in range(int(rng.integers(6, 120)))]
        for _ in range(8):
            base = list(base)
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(len(base)))] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(base))
            texts.append(" ".join(passage + base[: int(rng.integers(1, 12))]))
    texts += ["one two", "one  TWO", "one two three four", "a b c d e", "a b c d e f", "", " \n"]
    return list(enumerate(texts))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def powers():
    return jj._powers(jj._BASE), jj._powers(pow(jj._BASE, -1, 1 << 64))


def test_blocks_give_the_same_shingles(monkeypatch):
    texts = [LONG, "a b c", "x" * 5000, " a  b\tc\nd e f ", "", "Über über ÜBER a A", "no space at the end ", "q" * 64 + " " + "r" * 7]
    whole = [jj.word_hashes(t.encode(), powers()) for t in texts]
    for text, hashes in zip(texts, whole):
        w = words(text)
        assert len(hashes) == len(w) and len(set(hashes.tolist())) == len(set(w))
        assert len(jj.shingles(text.encode(), 5, powers())) == len(brute_sets(text))
    of = dict(zip([x for t in texts for x in words(t)], np.concatenate(whole).tolist()))
    assert [of[x] for t in texts for x in words(t)] == np.concatenate(whole).tolist()
    for block in (1, 7, 64):
        monkeypatch.setattr(jj, "_BLOCK", block)
        assert all((jj.word_hashes(t.encode(), powers()) == h).all() for t, h in zip(texts[1:], whole[1:]))


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_one_tree_finds_all_pairs(percent):
    rng = np.random.default_rng(percent)
    for _ in range(30):
        groups = [rng.choice(80, int(rng.integers(1, 40)), replace=False) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = set(groups[int(rng.integers(4))].tolist())
            s ^= set(rng.integers(0, 80, int(rng.integers(0, 4))).tolist())
            if s:
                sets.append(np.array(sorted(s)))
        alone = rng.integers(0, 3, len(sets))  # tokens that no other set has
        sizes = np.array([len(s) for s in sets]) + alone
        want = {
            (a, b): len(set(sets[a]) & set(sets[b]))
            for a in range(len(sets))
            for b in range(a)
            if (100 + percent) * len(set(sets[a]) & set(sets[b])) >= percent * (sizes[a] + sizes[b])
        }
        labels = np.arange(len(sets))
        got = {(max(a, b), min(a, b)): c for a, b, c in jj.linked(sets, sizes, labels, percent, True)}
        assert got == want
        some = jj.linked(sets, sizes, labels, percent, False)
        roots = []
        for pairs in (want, [(a, b) for a, b, _ in some]):
            root = list(range(len(sets)))
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root]
            roots.append([root.index(r) for r in root])
        assert roots[0] == roots[1]
        assert len(some) == len(sets) - len(set(roots[0]))


def test_rows(spark):
    got = jj.near_duplicates(frame(spark)).collect()
    assert by_key(got) == by_key(brute([(r[0], r[1]) for r in ROWS])[0])
    assert jj.near_duplicates(frame(spark, [])).collect() == []
    alone = jj.near_duplicates(docs(spark, [(1, ""), (2, None), (3, "x y z")])).collect()
    assert by_key(alone) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_whole_table(spark):
    rows = [(d["doc_id"], d["text"]) for d in table("documents")]
    assert by_key(jj.near_duplicates(docs(spark, rows)).collect()) == by_key(brute(rows)[0])


@pytest.mark.parametrize("tree, few", [(1 << 20, 1 << 20), (300, 0)])
def test_groups_larger_than_a_tree(spark, monkeypatch, tree, few):
    monkeypatch.setattr(jj, "TREE", tree)
    monkeypatch.setattr(jj, "FEW", few)
    monkeypatch.setattr(jj, "_SEEN", few)
    monkeypatch.setattr(jj, "PIVOT", 2)
    rows = edited_texts()
    want, links = brute(rows)
    df = docs(spark, rows)
    assert by_key(jj.near_duplicates(df.withColumn("n", F.lit("x"))).collect()) == by_key(want)
    pairs, members = jj.similar_sets(df)
    text = dict(rows)
    of = {r["class"]: frozenset(brute_sets(text[r["doc_id"]])) for r in members.collect() if r["class"] is not None}
    got = [(frozenset((of[r["u"]], of[r["v"]])), r["common"]) for r in pairs.collect()]
    assert {p for p, _ in got} == links and len(got) == len(links)
    assert all(c == len(frozenset.intersection(*p)) for p, c in got)


def test_a_chain_links_its_ends(spark):
    base = [*WORDS, *[f"t{k}" for k in range(40)]]
    rows = [(100 - k, " ".join([*[f"z{j}" for j in range(k)], *base[k:]])) for k in range(20)]
    want = brute(rows)[0]
    assert {c for _, _, c in want} == {81}
    assert by_key(jj.near_duplicates(docs(spark, rows)).collect()) == by_key(want)
