from collections import Counter

import xxhash
from pyspark.sql import functions as F
from samples import ROWS, frame, table, words

from gridlake.llm import simhash
from gridlake.llm.simhash import _meetings, components, drop_near_duplicates, fingerprint, links, near_duplicates


def brute_fingerprint(text):
    w = words(text)
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """Smallest id in reach of each row of (id, fingerprint)."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    first = {}
    for i, f in pairs:
        if i is not None:
            first[find(f)] = min(i, first.get(find(f), i))
    return [(i, f"{f:016x}", first.get(find(f))) for i, f in pairs]


def test_fingerprints():
    for _, text, _, _ in ROWS:
        assert fingerprint((text or "").encode()) % (1 << 64) == brute_fingerprint(text)


def test_rows(spark):
    got = [tuple(r) for r in near_duplicates(frame(spark)).collect()]
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in ROWS])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_duplicates(frame(spark, [])).collect() == []


def test_table(spark):
    docs = table("documents")
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    got = [tuple(r) for r in near_duplicates(df).collect()]
    assert sorted(got) == sorted(brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in docs]))


def numbers():
    """Groups of fingerprints within few bits of a centre, with chains, and far ones."""
    out = set()
    for k in range(12):
        centre = xxhash.xxh64_intdigest(str(k).encode())
        out.add(centre)
        for j in range(8):
            bits = xxhash.xxh64_intdigest(f"{k}.{j}".encode())
            for n in range(j % 6):
                out.add(centre ^ sum(1 << (bits >> (6 * m) & 63) for m in {*range(n + 1)}))
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


def test_links_connect_what_is_near(spark):
    fps = numbers()
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for distance in (1, 2, 3, 4):
        got = {r["node"]: r["root"] for r in components(links(df, distance)).collect()}
        root = {f: f for f in fps}
        for _ in fps:
            for a in fps:
                for b in fps:
                    if ((a ^ b) % (1 << 64)).bit_count() <= distance:
                        root[a] = root[b] = min(root[a], root[b])
            if all(root[a] == root[b] for a in fps for b in fps if ((a ^ b) % (1 << 64)).bit_count() <= distance):
                break
        assert {f: got.get(f, f) for f in fps} == root
    near = {a for a in fps for b in fps if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert near <= {r["fp"] for r in _meetings(df).collect()}


def test_planted_pairs_in_all_ranges(spark):
    """Pairs 0 to 4 bits apart, the bits dealt over the three ranges in every way, and far ones."""
    spots = ((0, 20, 9, 3), (21, 41, 30, 35), (42, 63, 50, 60))
    fps, linked, apart = [], [], []
    for k, (a, b, c) in enumerate((a, b, c) for a in range(6) for b in range(6) for c in range(6) if a + b + c <= 5):
        bits = [*spots[0][:a], *spots[1][:b], *spots[2][:c]]
        if len(bits) != a + b + c:
            continue
        one = xxhash.xxh64_intdigest(f"pair {k}")
        two = one ^ sum(1 << x for x in bits)
        one, two = (x - (1 << 64) if x >> 63 else x for x in (one, two))
        fps += {one, two}
        (linked if len(bits) <= 4 else apart).append((one, two))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components(links(df)).collect()}
    assert all(got.get(a, a) == got.get(b, b) for a, b in linked)
    assert all(got.get(a, a) != got.get(b, b) for a, b in apart)


def test_a_large_near_group(spark):
    """Many fingerprints around one centre, some tied only through others."""
    centre = xxhash.xxh64_intdigest("centre")
    fps = {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 5) for b in range(0, 64, 7) for c in range(0, 64, 11)}
    fps |= {centre ^ 0xFFFF0000 ^ (1 << a) for a in range(8)} | {centre ^ 0xFF000000 ^ (1 << a) for a in range(8)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {r["node"]: r["root"] for r in components(links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()}
    want = {i: first for i, _, first in brute_components([(f, f % (1 << 64)) for f in fps])}
    assert {f: got.get(f, f) for f in fps} == want


def test_groups_with_few_strays_need_no_balls(spark, monkeypatch):
    """One is tied through a member that is not the smallest, another is tied to none."""
    centre = xxhash.xxh64_intdigest("centre")
    flipped = [*({a} for a in range(42, 64)), {42, 43, 44}, {*range(42, 48)}, {*range(50, 61)}]
    fps = {centre} | {centre ^ sum(1 << b for b in bits) for bits in flipped}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = {i: first for i, _, first in brute_components([(f, f % (1 << 64)) for f in fps])}
    sent, ball = [], simhash._ball
    monkeypatch.setattr(simhash, "_ball", lambda open_fps, radius: sent.append(open_fps.count()) or ball(open_fps, radius))
    for few, balls in ((simhash.FEW_STRAYS, 0), (1, len(fps))):
        monkeypatch.setattr(simhash, "FEW_STRAYS", few)
        got = {r["node"]: r["root"] for r in components(links(df)).collect()}
        assert {f: got.get(f, f) for f in fps} == want and sent.pop() == balls


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 350)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(300, 350)]}


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {w[2] for w in brute_components([(r[0], brute_fingerprint(r[1])) for r in ROWS])}
    got = Counter(r["doc_id"] for r in kept.collect())
    assert set(got) == want and got[7] == 1 and got[2] == 1
    assert kept.where(F.col("doc_id").isin(3, 4, 8)).count() == 0
