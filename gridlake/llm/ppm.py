"""Scores of texts by prediction by partial matching over bytes."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import flat, pieces, stored

# Bytes of context, and bytes of text that a task counts or scores together.
ORDER = 5
CHUNK_BYTES = 16 << 20

# Symbols are the 256 bytes and the end of a text. A sequence of them is a number of 9 bits for each
# after a leading 1, so that the empty context is 1.
END, SHIFT = 256, 9
SYMBOLS = END + 1
# Bytes of text whose windows are sorted at once.
_BLOCK = 2 << 20


def _symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, lower-cased and with an end after each, and where each text begins."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int16)
    return np.insert(lower, at[1:], END), at[:-1] + np.arange(len(at) - 1)


class Windows:
    """Every symbol of some texts with up to ``order`` symbols before it.

    ``keys`` are the different windows, as numbers whose first digit is the symbol itself, then the one
    before it and so on, and 0 beyond the beginning of the text. ``number`` tells for each symbol
    which window it has. Digits stand for the symbols in ``alphabet``.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, order: int):
        x, self.starts = _symbols(data, at)
        present = np.bincount(x, minlength=SYMBOLS) > 0
        self.alphabet = np.concatenate(([-1], np.flatnonzero(present)))
        digits = np.cumsum(present)[x].astype(np.uint64)
        self.bits = max(1, int(len(self.alphabet) - 1).bit_length())
        self.order = order
        place = np.arange(len(x)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(x))))
        keys = digits.copy()
        for k in range(1, order + 1):
            before = np.zeros(len(x), np.uint64)
            before[k:] = digits[: len(x) - k]
            before[place < k] = 0
            keys = (keys << np.uint64(self.bits)) | before
        room = 64 - self.bits * (order + 1)
        if len(x) <= 1 << room:
            # One sort of windows and places together.
            both = np.sort((keys << np.uint64(room)) | np.arange(len(x), dtype=np.uint64))
            ordered, where = both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)
            first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(x) else np.zeros(0, bool)
            self.keys = ordered[first]
            self.number = np.zeros(len(x), np.int64)
            self.number[where] = np.cumsum(first) - 1
        else:
            self.keys, self.number = np.unique(keys, return_inverse=True)

    def digit(self, k: int) -> np.ndarray:
        """The symbols ``k`` before the last ones, -1 beyond the beginning."""
        low = np.uint64(self.bits * (self.order - k))
        return self.alphabet[((self.keys >> low) & np.uint64((1 << self.bits) - 1)).astype(np.int64)]

    def sequences(self, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sequences of up to ``order + 1`` symbols within texts, and how often they end at ``learned``
        symbols."""
        counts = np.bincount(self.number[learned], minlength=len(self.keys))
        out_keys, out_counts = [], []
        # From the symbol alone to the whole window: those that agree so far stand together.
        key = np.ones(len(self.keys), np.int64)
        inside = np.ones(len(self.keys), bool)
        for k in range(self.order + 1):
            symbol = self.digit(k)
            inside &= symbol >= 0
            # The symbol k before the last goes in front: after the leading 1, which moves up.
            key = np.where(inside, key + (np.maximum(symbol, 0) << (SHIFT * k)) + (1 << (SHIFT * (k + 1))) - (1 << (SHIFT * k)), key)
            some = np.flatnonzero(inside)
            if len(some) == 0:
                break
            first = np.flatnonzero(np.concatenate(([True], key[some][1:] != key[some][:-1])))
            out_keys.append(key[some][first])
            out_counts.append(np.add.reduceat(counts[some], first))
        return np.concatenate(out_keys), np.concatenate(out_counts)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def words_of(text: bytes) -> list[bytes]:
    """Tokens of a text: lower-cased words between ASCII white space, and an empty one as its end."""
    return [*text.lower().split(), b""]


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Bytes and offsets of some texts at a time, and their rows."""
    for batch in pieces(table.to_batches(), _BLOCK):
        yield *flat(batch["text"]), batch


def _texts(data: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    raw, at = data.tobytes(), at.tolist()
    for a, b in zip(at, at[1:]):
        yield raw[a:b]


def _pack(**columns: pa.Array) -> bytes:
    """Columns as one compressed value, so that a shuffle moves a few large rows."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(values: pa.ChunkedArray) -> list[pa.RecordBatch]:
    return [b for v in values if v.is_valid for b in pa.ipc.open_stream(v.as_buffer())]


def _count(table: pa.Table, order: int, parts: int) -> pa.Table:
    """Sequences and words of a chunk, and how often they occur in texts to learn from (perhaps never),
    dealt out to ``parts``: sequences by their context, and words by themselves."""
    words: Counter[bytes] = Counter()
    keys, counts = [], []
    for data, at, batch in _blocks(table):
        learn = np.array(batch["learn"].to_pylist(), bool)
        for text, known in zip(_texts(data, at), learn.tolist()):
            words.update(words_of(text)) if known else words.update(dict.fromkeys(words_of(text), 0))
        found = Windows(data, at, order)
        learned = np.repeat(learn, np.diff(at) + 1)
        more = found.sequences(learned)
        keys.append(more[0]), counts.append(more[1])
    key, count = _merged(keys, counts)
    factor = np.uint64(0x9E3779B97F4A7C15)
    part = (((key >> SHIFT).astype(np.uint64) * factor) >> np.uint64(33)).astype(np.int64) % parts
    listed, times = list(words), np.fromiter(words.values(), np.int64, len(words))
    word_part = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % parts
    by_part = [np.split(np.argsort(p, kind="stable"), np.cumsum(np.bincount(p, minlength=parts))[:-1]) for p in (part, word_part)]
    listed = pa.array(listed, pa.binary())
    grams = [_pack(key=pa.array(key[k]), n=pa.array(count[k])) if len(k) else None for k in by_part[0]]
    texts = [_pack(word=listed.take(pa.array(k)), n=pa.array(times[k])) if len(k) else None for k in by_part[1]]
    chunk = np.full(parts, table["chunk"][0].as_py(), np.int32)
    return pa.table(
        {"part": pa.array(np.arange(parts, dtype=np.int32)), "chunk": chunk, "grams": pa.array(grams, pa.binary()), "words": pa.array(texts, pa.binary())}
    )


def _answer(table: pa.Table) -> pa.Table:
    """What all chunks together know of what each chunk has: for its contexts the symbols that follow and how
    often, and for its words how often they occur and whether it is the first chunk that has them."""
    chunks = np.asarray(table["chunk"])
    present = np.unique(chunks)
    answers = {c: [None, None] for c in present.tolist()}

    def gathered(name: str) -> tuple[pa.Table, np.ndarray] | None:
        has = np.asarray(table[name].is_valid())
        if not has.any():
            return None
        batches = _unpack(table[name])
        return pa.Table.from_batches(batches), np.repeat(chunks[has], [b.num_rows for b in batches])

    if (found := gathered("grams")) is not None:
        rows, chunk = found
        key, n = np.asarray(rows["key"]), np.asarray(rows["n"])
        total_key, total = _merged([key], [n])
        context = total_key >> SHIFT
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        contexts = context[first]
        learned = total > 0
        sizes = np.add.reduceat(learned.astype(np.int64), first)
        symbols, total = (total_key[learned] & 511).astype(np.int16), total[learned]
        starts = np.cumsum(sizes) - sizes
        asked = np.unique(chunk.astype(np.int64) * len(contexts) + np.searchsorted(contexts, key >> SHIFT))
        for c in present.tolist():
            lo, hi = np.searchsorted(asked, [c * len(contexts), (c + 1) * len(contexts)])
            which = asked[lo:hi] - c * len(contexts)
            which = which[sizes[which] > 0]
            size = sizes[which]
            at = np.repeat(starts[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            answers[c][0] = _pack(
                context=pa.array(contexts[which]),
                symbols=pa.ListArray.from_arrays(offsets, pa.array(symbols[at])),
                counts=pa.ListArray.from_arrays(offsets, pa.array(total[at])),
            )
    if (found := gathered("words")) is not None:
        rows, chunk = found
        coded = rows["word"].combine_chunks()
        coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        code = np.asarray(coded.indices)
        total = np.bincount(code, np.asarray(rows["n"]), len(coded.dictionary)).astype(np.int64)
        first = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(first, code, chunk)
        order = np.argsort(chunk, kind="stable")
        for c, some in zip(present.tolist(), np.split(order, np.searchsorted(chunk[order], present)[1:])):
            mine = code[some]
            mine = mine[total[mine] > 0]
            answers[c][1] = _pack(
                word=coded.dictionary.take(pa.array(mine)), n=pa.array(total[mine]), first=pa.array(first[mine] == c)
            )
    return pa.table(
        {
            "chunk": pa.array(list(answers), pa.int32()),
            "grams": pa.array([a[0] for a in answers.values()], pa.binary()),
            "words": pa.array([a[1] for a in answers.values()], pa.binary()),
        }
    )


class Model:
    """What training says of some contexts: the symbols that follow each and how often."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(contexts, kind="stable")
        starts = np.cumsum(sizes) - sizes
        self.contexts, self.kinds = contexts[order], sizes[order]
        at = np.repeat(starts[order] - (np.cumsum(self.kinds) - self.kinds), self.kinds) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(order)), self.kinds)
        # Sequences of a context and a symbol are in order, as contexts and their symbols are.
        self.keys = (self.contexts[owner] << SHIFT) | symbols[at]
        self.counts = counts[at].astype(float)
        self.totals = np.bincount(owner, self.counts, len(order))
        # How often the symbols that follow a context follow it without its first symbol.
        length = np.zeros(len(order), np.int64)
        for k in range(1, 7):
            length[self.contexts >= 1 << (SHIFT * k)] = k
        low = np.int64(1) << (SHIFT * np.maximum(length - 1, 0))
        shorter = (self.contexts & (low - 1)) | low
        self.shorter = np.bincount(owner, self.count((shorter[owner] << SHIFT) | symbols[at]), len(order))

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How often sequences occur, 0 if their context is not known."""
        if len(self.keys) == 0:
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of contexts, and whether they are known."""
        if len(self.contexts) == 0:
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return at, self.contexts[at] == contexts

    def log_chances(self, windows: Windows) -> np.ndarray:
        """log10 of the chance of the last symbol of each window after those before it.

        From the longest context down: a symbol that has followed the context n times of N gets
        (2n - 1) / 2N, and the rest, 1 / 2N for each symbol seen, is the chance of an escape to the next
        context (method D). Symbols seen in a longer context cannot come in a shorter one any more: their
        counts are left out there. After the empty context come the symbols never seen, all alike.
        """
        digits = [windows.digit(k) for k in range(windows.order + 1)]
        contexts = [np.ones(len(windows.keys), np.int64)]
        inside = [np.ones(len(windows.keys), bool)]
        for k in range(1, windows.order + 1):
            step = (np.maximum(digits[k], 0) << (SHIFT * (k - 1))) + (1 << (SHIFT * k)) - (1 << (SHIFT * (k - 1)))
            contexts.append(contexts[-1] + step)
            inside.append(inside[-1] & (digits[k] >= 0))
        out = np.zeros(len(windows.keys))
        rest = np.arange(len(out))
        cut_n, cut_d = np.zeros(len(out)), np.zeros(len(out))
        for k in range(windows.order, -1, -1):
            context = contexts[k][rest]
            row, known = self.find(context)
            known &= inside[k][rest]
            if not known.any():
                continue
            left_n = np.where(known, self.totals[row] - cut_n, 0)
            left_d = np.where(known, self.kinds[row] - cut_d, 0)
            coded = left_n > 0
            count = np.zeros(len(rest))
            count[coded] = self.count((context[coded] << SHIFT) | digits[0][rest][coded])
            hit = count > 0
            out[rest[hit]] += np.log10((2 * count[hit] - 1) / (2 * left_n[hit]))
            escaped = coded & ~hit
            out[rest[escaped]] += np.log10(left_d[escaped] / (2 * left_n[escaped]))
            cut_n, cut_d = (np.where(known, a[row], 0)[~hit] for a in (self.shorter, self.kinds))
            rest = rest[~hit]
        row, known = self.find(np.array([1]))
        seen = int(self.kinds[row[0]]) if known[0] else 0
        out[rest] -= np.log10(max(1, SYMBOLS - seen))
        return out


def _model(values: pa.ChunkedArray) -> Model:
    batches = _unpack(values)
    lists = [(b["symbols"], b["counts"]) for b in batches]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Model(
        join([np.asarray(b["context"]) for b in batches], np.int64),
        join([np.diff(np.asarray(s.offsets)) for s, _ in lists], np.int64).astype(np.int64),
        join([np.asarray(s.flatten()) for s, _ in lists], np.int64).astype(np.int64),
        join([np.asarray(c.flatten()) for _, c in lists], np.int64),
    )


def _score(docs: pa.Table, found: pa.Table, order: int) -> pa.Table:
    model = _model(found["grams"])
    counts_of: dict[bytes, int] = {}
    first = 0
    for batch in _unpack(found["words"]):
        counts_of.update(zip(batch["word"].to_pylist(), batch["n"].to_pylist()))
        first += int(np.asarray(batch["first"].to_numpy(zero_copy_only=False)).sum())
    tokens, known, base, scores = [], [], [], []
    for data, at, _ in _blocks(docs):
        for text in _texts(data, at):
            words = words_of(text)
            c = np.fromiter(map(counts_of.get, words, repeat(0)), np.int64, len(words))
            tokens.append(len(words))
            known.append(int(np.count_nonzero(c)))
            base.append(float(np.log10(c + 0.5).sum()))
        windows = Windows(data, at, order)
        scores.append(np.add.reduceat(model.log_chances(windows)[windows.number], windows.starts))
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "learn": docs["learn"],
            "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": pa.array(known, pa.int64()),
            "base": pa.array(base, pa.float64()),
            "score": pa.array(np.concatenate(scores)),
            # Of the different words of training, those that this chunk is the first to have.
            "first_words": pa.array([first] + [0] * (len(tokens) - 1), pa.int64()),
        }
    )


def score(
    docs: DataFrame, may_learn: Column, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (``doc_id, text``).

    Texts whose ``doc_id`` meets ``may_learn`` teach the model, and all are scored by it: ``score`` is the
    log10 of the chance that a model of bytes by up to ``order`` bytes before (5 at most) gives the
    lower-cased text and its end, and ``base_score`` that of its words one by one.

    Texts are dealt out in chunks of about ``chunk_bytes``. Each chunk counts its sequences and words and
    sends them to as many parts, by context; a part adds up the counts of all chunks, and answers each
    with what is known of the contexts and words that it has. So counts are of all training texts, and
    a task's memory follows its chunk or part, not the corpus. Texts are shuffled once.

    A null or empty text is its end alone. Null ids learn if ``may_learn`` holds for them. Repeated rows
    count and are scored each for itself. With nothing to learn from, all symbols are alike. Extra columns
    are ignored.
    """
    if not 1 <= order <= 5:
        raise ValueError(f"order must be from 1 to 5, got {order}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    n = max(1, -(-size // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    rows = rows.withColumns({"learn": F.coalesce(may_learn, F.lit(False)), "chunk": chunk})
    dealt = rows.repartition(n, "chunk")
    counted = dealt.groupBy("chunk").applyInArrow(
        lambda table: _count(table, order, n), "part int, chunk int, grams binary, words binary"
    )
    answers = counted.repartition(n, "part").groupBy("part").applyInArrow(
        _answer, "chunk int, grams binary, words binary"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            lambda texts, found: _score(texts, found, order),
            f"doc_id {kind}, learn boolean, n_tokens bigint, n_known bigint, base double, score double, first_words bigint",
        )
    )
    scored = stored(scored, "ppm")
    learned = F.sum(F.when(F.col("learn"), F.col("n_tokens")))
    n_tokens, n_words = (int(x or 0) for x in scored.agg(learned, F.sum("first_words")).first())
    unit = F.lit(float(np.log10(n_tokens + 0.5 * (n_words + 1))))
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * unit).alias("base_score"),
        "score",
    )
