"""Benchmark decontamination: passages of test items found in training documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import pieces, raw_texts, stored, text_of, unused, widened, with_columns

# Bytes of test items behind one broadcast. More items are looked for in several passes.
MAX_ITEM_BYTES = 16 << 20

SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

# Words are runs of digits, letters and non-ASCII characters: in UTF-8, A-Z become a-z and all
# other ASCII bytes become spaces.
_FOLD = bytes(
    ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)
) + bytes(range(128, 256))

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Windows:
    """Windows of some test items, by number of words.

    ``hashes`` is what documents are scanned with; ``items`` verifies a match and names the
    items that a window occurs in.
    """

    vocabulary: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    items: dict[int, dict[bytes, set[str]]]


def _hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` word numbers from each of ``starts`` on."""
    value = np.zeros(len(starts), np.uint64)
    for k in range(n):
        value = (value ^ ids[starts + k].astype(np.uint64)) * _FACTOR
        value ^= value >> np.uint64(29)
    return value


def index_windows(items: Iterable[tuple[str | None, str | None]], n: int) -> Windows:
    """Index the windows of ``n`` words; an item of fewer words, but not none, is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        if not words:
            continue
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)
        m = min(n, len(ids))
        for start in range(len(ids) - m + 1):
            names = found.setdefault(m, {}).setdefault(ids[start : start + m].tobytes(), set())
            if item is not None:
                names.add(item)
    hashes = {}
    for m, windows in found.items():
        ids = np.frombuffer(b"".join(windows), np.int32)
        hashes[m] = np.unique(_hash(ids, np.arange(0, len(ids), m), m))
    return Windows(vocabulary, hashes, found)


def find_windows(text: bytes, index: Windows) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, ranges of words inside occurrences, and items that occur."""
    words = words_of(text)
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int32, len(words))
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for m, hashes in index.hashes.items():
        # Only windows of words that all occur in some item can match.
        starts = np.flatnonzero(known[m:] - known[:-m] == m) if len(ids) >= m else known[:0]
        if len(starts) == 0:
            continue
        for start in starts[np.isin(_hash(ids, starts, m), hashes)].tolist():
            names = index.items[m].get(ids[start : start + m].tobytes())
            if names is not None:
                items |= names
                spans.append((start, start + m))
    return len(words), spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions in ascending ranges that do not touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(
    batches: Iterable[pa.RecordBatch],
    index: Broadcast,
    names: tuple[str, str, str],
    again: bool,
    text: str,
) -> Iterator[pa.RecordBatch]:
    """``again``: an earlier pass has left its finds in the columns ``names``."""
    n_words, spans, items = names
    for batch in batches:
        counts, places, found = [], [], []
        before = zip(batch[spans].to_pylist(), batch[items].to_pylist()) if again else repeat(([], []))
        for raw, (old_spans, old_items) in zip(raw_texts(batch[text]), before):
            count, at, which = find_windows(raw, index.value)
            counts.append(count)
            at += [(x["start"], x["end"]) for x in old_spans]
            places.append([{"start": a, "end": b} for a, b in merged(at)])
            found.append(sorted(which.union(old_items)))
        new = {
            n_words: pa.array(counts, pa.int64()),
            spans: pa.array(places, _SPANS),
            items: pa.array(found, pa.list_(pa.string())),
        }
        yield with_columns(batch, names, **new)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    max_item_bytes: int = MAX_ITEM_BYTES,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """All columns of ``docs`` and, under ``names``: the number of words, the ranges of words
    that lie inside a window of a test item (disjoint, ascending), and the item ids as sorted
    strings. Columns of ``docs`` that have such a name are replaced.

    A window is ``n`` consecutive words of an item (``item_id``, ``text``); an item of fewer words
    is one window. Windows of at most ``max_item_bytes`` of item text are broadcast as a hash
    set; more items are dealt out by hash to several passes over the documents, each with a set
    of that size, and each adds to what the passes before it found. No shuffle of documents.

    A null text has no words. A null item id counts for ranges but names no item; repeated ids
    count once. Repeated documents are scanned each for itself. An empty table on either side
    gives no finds. Other columns of ``benchmark`` are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_of(benchmark).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // max_item_bytes))
    names = tuple(names)
    out = docs.drop(*names)
    schema = widened(out, **{names[0]: "bigint", names[1]: SPANS, names[2]: "array<string>"})
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        index = spark.sparkContext.broadcast(
            index_windows(((r.item, r.text) for r in part.toLocalIterator()), n)
        )
        out = out.mapInArrow(
            lambda batches, index=index, again=k > 0: _scan(pieces(batches), index, names, again, "text"),
            schema,
        )
        if k < passes - 1:
            out = stored(out, "decontamination")
    return out


def is_contaminated(n_words: str, spans: str, share: int = 20):
    """Whether at least one in ``share`` words is hit, and at least one word."""
    hit = n_hit(spans)
    return (hit > 0) & (hit * share >= F.col(n_words))


def n_hit(spans: str):
    """Number of words in the ranges."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    names = tuple(unused(docs, x) for x in ("n_words", "spans", "items"))
    found = find_contamination(docs, benchmark, n, names=names)
    return found.where(~is_contaminated(names[0], names[1], share)).select(*docs.columns)


def _cut(batches: Iterable[pa.RecordBatch], spans: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for raw, null, places in zip(
            raw_texts(batch["text"]), batch["text"].is_null().to_pylist(), batch[spans].to_pylist()
        ):
            texts.append(None if null else remove_words(raw, [(x["start"], x["end"]) for x in places]))
        new = pa.array(texts, pa.string())
        names = [x for x in batch.schema.names if x != spans]
        yield pa.RecordBatch.from_arrays([new if x == "text" else batch[x] for x in names], names=names)


def remove_words(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans`` and what stands between them."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    starts, ends = edges[::2].tolist(), edges[1::2].tolist()
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*out, text[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """All documents, with the words inside occurring windows cut out of their texts."""
    names = tuple(unused(docs, x) for x in ("n_words", "spans", "items"))
    found = find_contamination(docs, benchmark, n, names=names).drop(names[0], names[2])
    spans = names[1]
    return found.mapInArrow(lambda batches: _cut(batches, spans), docs.schema)
