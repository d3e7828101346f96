import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from samples import ROWS, frame, table
from tokenizers import Tokenizer

from gridlake.llm import token_files
from gridlake.llm.common import flat, scratch
from gridlake.llm.token_files import WordEncoder, encode_documents, read_tokens, with_starts, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)

ODD = [
    "Hello, World. It's fine... A,B .,. don't!",
    "İSTANBUL ΣΑΣ. É, é, é, ́a",
    "<|endoftext|> X<|endoftext|>Y <|ENDOFTEXT|>, a",
    "\x1c a\x85b c D. x\x00, \x00.",
    "123, 4. x1, 1x. 's. don'T. 'S, 'Re.",
    "a,", ",", "Z", "ab. c", "übeR, straSSe ß ÿ",
]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_is_the_tokenizer():
    encoder = WordEncoder(PATH, 2)
    assert encoder.letters.fullmatch("abc")
    for texts in ([r[1] for r in ROWS], ODD, [t for t in ODD if "<|" not in t], [None], [""], [d["text"] for d in table("documents")]):
        ids, counts = encoder.encode(*flat(pa.array(texts, pa.string())))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


def test_encoder_is_the_tokenizer_on_words_with_signs():
    rng = np.random.default_rng(5)
    letters = [*"abzABZ019'", "é", "ß", "İ", "\x00", "\x85", "中", *" \t\n  ", *".,.,!?$*&#<|>_-()\"", "!!", "..."]
    encoder = WordEncoder(PATH, 2)
    for _ in range(400):
        texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(20)]
        ids, counts = encoder.encode(*flat(pa.array(texts, pa.string())))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("gridlake.llm.token_files.MAX_WORDS", 50)
    encoder = WordEncoder(PATH, 2)
    for d in table("documents")[:40]:
        ids, _ = encoder.encode(*flat(pa.array([d["text"]])))
        assert ids.tolist() == ids_of(d["text"])


def test_forgetting_all_or_sharing_places_changes_nothing(monkeypatch):
    texts = [t + " a a\x00 a\x00\x00 \x00 abcdefghijklmno abcdefghijklmnop abcdefghijklmno\x00 abcdefgh abcdefgh\x00" for t in (*ODD, "zz")]
    texts += [d["text"] for d in table("documents")[:40]]
    for name, value in (("PLACES_BITS", 3), ("MAX_ENTRIES", 50)):
        monkeypatch.setattr(token_files, name, value)
        encoder = WordEncoder(PATH, 2)
        for text in texts:
            ids, _ = encoder.encode(*flat(pa.array([text])))
            assert ids.tolist() == ids_of(text)


def test_known_words_are_looked_up_together():
    """Words met before take no step each, also when the dict has been emptied."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    encoder = WordEncoder(PATH, 2)
    text = "in it a to, be of. an International; don't " * 200
    first, _ = encoder.encode(*flat(pa.array([text])))
    encoder.index = Counted()
    again, _ = encoder.encode(*flat(pa.array([text])))
    assert again.tolist() == first.tolist() == ids_of(text)
    assert Counted.asked == 0 and not encoder.index


def test_memory_of_a_batch(monkeypatch):
    """A batch of 4 MB of short words takes less than ten times as much on the way."""
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = ["in it a to, be of. an " * 200] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    next(token_files._encode([batch], PATH, 2))
    tracemalloc.start()
    made = [(out.num_rows, out["ids"][0].as_py()) for out in token_files._encode([batch], PATH, 2)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in made) == 1000 and all(ids == ids_of(texts[0]) for _, ids in made)
    assert peak < 40 << 20


def test_index(spark):
    got = sorted((tuple(r) for r in encode_documents(frame(spark), PATH).collect()), key=lambda r: r[1])
    # Null ids first; rows of equal id in some order.
    assert [r[0] for r in got] == sorted([r[0] for r in ROWS], key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    sums = sorted((r[0] or 0, len(ids_of(r[1])), zlib.crc32(np.array(ids_of(r[1]), "<u4").tobytes())) for r in ROWS)
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sums
    assert encode_documents(frame(spark, []), PATH).collect() == []


def test_files_round_trip_and_skip(spark):
    docs = table("documents")
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    path = scratch(spark, "test-tokens")
    write_tokens(df.repartition(3), path, PATH)
    tokens = read_tokens(spark, path)
    rows = with_starts(tokens).orderBy("start").collect()
    assert [(r["doc_id"], r["ids"]) for r in rows] == [(d["doc_id"], ids_of(d["text"])) for d in sorted(docs, key=lambda d: d["doc_id"])]
    assert tokens.where("doc_id = 77").select("ids").collect()[0][0] == ids_of(next(d for d in docs if d["doc_id"] == 77)["text"])
    plan = tokens.where("doc_id = 77").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,77)" in plan and "ids" not in plan.split("ReadSchema")[-1]
