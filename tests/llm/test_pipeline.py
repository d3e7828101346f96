"""The pipeline against the same steps done one document at a time."""

import zlib
from collections import Counter

import numpy as np
from samples import SF, ROWS, frame, table
from test_decontamination import brute
from test_simhash import brute_components, brute_fingerprint
from test_token_files import ids_of

import corpus_pipeline as pipeline
from gridlake.llm.common import read, stored
from gridlake.llm.common import remainder as fold_of
from gridlake.llm.toxicity import train, with_score


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages(spark):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    docs = read(spark, SF, "documents")
    columns = docs.columns
    rows = {d["doc_id"]: d["text"] for d in table("documents")}

    clean = stored(stage("toxicity")(spark, docs, SF), "test")
    toxic = {d["doc_id"]: d["toxic"] for d in table("labels")}
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and len(kept) == clean.count()
    # What goes is what the stage's model scores 0.7 or more; of that, few are labelled not toxic.
    model = train(docs, read(spark, SF, "labels"), fold_of("doc_id", 3) != 1)
    scores = {r["doc_id"]: r["score"] for r in with_score(docs, model).collect()}
    assert kept == {k for k in rows if scores[k] < 0.7}
    gone = [toxic[k] for k in rows.keys() - kept if k in toxic]
    clean_labels = sum(1 for t in toxic.values() if not t)
    assert sum(1 for t in gone if not t) <= 0.15 * clean_labels and sum(gone) >= 0.5 * sum(1 for t in toxic.values() if t)

    single = stored(stage("near_dedup")(spark, clean, SF), "test")
    assert single.columns == columns
    parts = brute_components([(k, brute_fingerprint(rows[k])) for k in sorted(kept)])
    kept = {k for k, _, first in parts if k == first}
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(kept)

    fresh = stored(stage("decontamination")(spark, single, SF), "test")
    assert fresh.columns == columns
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    order = sorted(kept)
    hits = brute([rows[k] for k in order], items)
    kept = {k for k, (n, hit, _) in zip(order, hits) if not (hit and 20 * len(hit) >= n)}
    assert {r["doc_id"] for r in fresh.collect()} == kept

    mixed = stored(stage("mixing")(spark, fresh, SF), "test")
    assert mixed.columns == columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= kept and max(copies.values()) <= 3

    got = sorted((tuple(r) for r in stage("token_files")(spark, mixed, SF).collect()), key=lambda r: r[1])
    want, start = [], 0
    for k in sorted(copies.elements()):
        ids = ids_of(rows[k])
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sorted((tuple(r) for r in pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == want


def test_odd_rows_and_no_rows(spark):
    for rows in (ROWS, []):
        docs = frame(spark, rows)
        for _, f in pipeline.STAGES[:-1]:
            docs = stored(f(spark, docs, SF), "test")
            assert docs.columns == frame(spark, rows).columns
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
