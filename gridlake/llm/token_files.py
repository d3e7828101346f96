"""Token ids of documents in ORC files, in order of their ids."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm.common import flat, pieces, scratch

# Words in a dict, which then starts anew. A dict of 174,763 would take twice the room.
MAX_WORDS = 170_000
# Words whose ids a task remembers, and 16 times as many ids; then all of it starts anew.
MAX_ENTRIES = 700_000
# Words of up to 15 bytes are looked up first in a table of 2 ** 18 places, each of which holds the last
# two put there: 16 bytes for a word and its length, and 4 for its entry.
PLACES_BITS = 18
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# What words of each length keep of their first 8 bytes and of the next 8, the last of which is the length.
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], np.uint64)
_NEXT = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(16)], np.uint64)
_LENGTH = np.arange(16, dtype=np.uint64) << np.uint64(56)
# Bytes of text that are encoded at once: arrays on the way take some 50 times as much.
PIECE = 256 << 10
# With at most so many files, their totals (16 bytes each) are broadcast.
MAX_BROADCAST_PARTS = 100_000

# Letters that every version of Unicode knows as lower-case letters without a composition: a-z, and
# those of Latin-1.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
NOTHING = re.compile("(?!)")
# ASCII signs other than letters, digits, white space, control characters and the apostrophe.
SIGNS = np.zeros(256, bool)
SIGNS[[k for k in range(33, 127) if not chr(k).isalnum() and k != ord("'")]] = True

# The layout: integers are run-length encoded by the format; each stripe has an index of rows and
# Bloom filters on the ids of documents.
LAYOUT = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "5000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes that end with white space begin and end."""
    space = np.empty(len(data) + 1, bool)
    space[0] = True
    np.less(data - np.uint8(9), 5, out=space[1:])
    space[1:] |= data == 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def _before_signs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last byte before each of ``ends`` that is no sign; each has one before it."""
    last = ends - 1
    for _ in range(16):
        signs = np.flatnonzero(SIGNS[data[last]])
        if not len(signs):
            return last
        last[signs] -= 1
    others = np.flatnonzero(~SIGNS[data])
    return others[np.searchsorted(others, last, "right") - 1]


def _short_words(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Which words have 15 bytes at most, these as two numbers each, equal for equal words only, and their places."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    at = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    short = lengths < 16
    length = np.where(short, lengths, 0)
    first = at[starts] & _FIRST.take(length)
    after = (at[starts + 8] & _NEXT.take(length)) | _LENGTH.take(length)
    mixed = first * MULTIPLIERS[0]
    mixed ^= mixed >> np.uint64(32)
    mixed = (mixed + after) * MULTIPLIERS[1]
    return short, (first, after), (mixed >> np.uint64(64 - PLACES_BITS)).astype(np.int64)


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a longer copy of it, with room for ``more`` numbers after those ``used``."""
    if used + more <= len(array):
        return array
    out = np.empty(max(2 * len(array), used + more), array.dtype)
    out[:used] = array[:used]
    return out


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space.

    For such a tokenizer the ids of a text are those of its words, in order, so each word is encoded
    once and looked up afterwards. Where it also lower-cases, and ends a token between a letter and
    signs after it, "Word," is looked up as "word" and ",", and "word!?" as "word" and "!?".

    Words are looked up together, as numbers in a table; those that are not there, one by one in a dict.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.heads = {s[:2].encode() for s in self.special}
        self.folds = self._ids("Ab,") == self._ids("ab") + self._ids(",") and self._ids("Ab.") == self._ids(
            "ab"
        ) + self._ids(".")
        # Words of lower-case letters alone need no normalizer and no pattern: the model and the end of
        # word that it marks are enough.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.plain = Tokenizer(self.tokenizer.model)
        # Bytes of ASCII letters stand for themselves in such a model.
        self.split_ascii = pre_tokenizers.WhitespaceSplit()
        self.split = pre_tokenizers.Sequence(
            [self.split_ascii, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        probe = ["a", "über", "s", "strasse", "élèves", "nn", "abcdefghijklmnopqrstuvwxyz"]
        alike = all(self._ids(w) == self._plain_ids([w.encode()]).tolist() for w in probe)
        usable = suffix and self.folds and alike
        usable = usable and self._ids("ab$$.") == self._ids("ab") + self._ids("$$.")
        self.letters = LETTERS if usable else NOTHING
        self._forget()

    def _plain_ids(self, words: list[bytes]) -> np.ndarray:
        joined = b" ".join(words)
        self.plain.pre_tokenizer = self.split_ascii if joined.isascii() else self.split
        return np.array(self.plain.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.int32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        # The first three entries are what may follow a word: nothing, a comma, a full stop.
        tails = [[], self._ids(","), self._ids(".")]
        self.index: dict[bytes, int] = {}
        self.lengths = np.array([len(t) for t in tails], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.ids = np.array([i for t in tails for i in t], np.int32)
        self.entries, self.n_ids = len(self.lengths), len(self.ids)
        self.places = np.zeros((1 << PLACES_BITS, 4), np.uint64)
        self.place_entries = np.zeros((1 << PLACES_BITS, 2), np.int32)

    def _encode_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, and how many each has."""
        ids = self._plain_ids(words)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and how many each has. Special tokens keep words apart in one call."""
        words = [w.decode() for w in raw]
        if not self.special or any(s in w for w in words for s in self.special):
            ids = [self._ids(w) for w in words]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)
        mark, number = next(iter(self.special.items()))
        joined = self.tokenizer.encode_batch_fast([mark.join([*words, ""])], add_special_tokens=False)[0]
        ids = np.array(joined.ids, np.int32)
        marks = np.flatnonzero(ids == number)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _learn(self, words: Iterable[bytes]) -> None:
        """Add words to the index."""
        usable = self.letters is LETTERS
        ascii_only, plain, other = [], [], []
        for word in words:
            if usable and word.isalpha() and word.islower():
                ascii_only.append(word)
            else:
                (plain if usable and LETTERS.fullmatch(word.decode()) else other).append(word)
        for encode, some in ((self._encode_letters, ascii_only), (self._encode_letters, plain), (self._encode_words, other)):
            for k in range(0, len(some), 1000):
                part = some[k : k + 1000]
                first = self._add(*encode(part))
                self.index.update(zip(part, range(first, first + len(part))))

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keep the ids of words, and return the entry of the first one."""
        first, last, upto = self.entries, self.entries + len(lengths), self.n_ids + len(ids)
        self.starts = _room(self.starts, first, len(lengths))
        self.lengths = _room(self.lengths, first, len(lengths))
        self.ids = _room(self.ids, self.n_ids, len(ids))
        self.starts[first:last] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.ids[self.n_ids : upto] = ids
        self.entries, self.n_ids = last, upto
        return first

    def _look_up(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entries of words, which are learned if they are new."""
        if self.entries > MAX_ENTRIES or self.n_ids > 16 * MAX_ENTRIES:
            self._forget()
        elif len(self.index) > MAX_WORDS:
            self.index = {}
        short, (first, after), places = _short_words(data, starts, lengths)
        held = self.places.take(places, axis=0)
        second = (held[:, 2] == first) & (held[:, 3] == after)
        hit = short & (second | ((held[:, 0] == first) & (held[:, 1] == after)))
        found = self.place_entries.take(2 * places + second)
        missing = np.flatnonzero(~hit)
        if len(missing):
            raw, begins = data.tobytes(), starts[missing]
            some = [raw[a:b] for a, b in zip(begins.tolist(), (begins + lengths[missing]).tolist())]
            entries = np.fromiter(map(self.index.get, some, repeat(-1)), np.int32, len(some))
            unknown = np.flatnonzero(entries < 0)
            if len(unknown):
                new = [some[k] for k in unknown.tolist()]
                self._learn(dict.fromkeys(new))
                entries[unknown] = np.fromiter(map(self.index.__getitem__, new), np.int32, len(new))
            found[missing] = entries
            kept = missing[short[missing]]
            # One word for each place, so that a place has the word and the entry of the same one.
            at, which = np.unique(places[kept], return_index=True)
            kept = kept[which]
            self.places[at, 2:], self.place_entries[at, 1] = self.places[at, :2], self.place_entries[at, 0]
            self.places[at, 0], self.places[at, 1], self.place_entries[at, 0] = first[kept], after[kept], found[kept]
        return found

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        """Ids of entries, one after another."""
        lengths = self.lengths.take(entries)
        upto = np.cumsum(lengths, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids.take(np.repeat(self.starts.take(entries) - (upto - lengths), lengths) + np.arange(total))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in one array of bytes with the end id after each, and how many each text has."""
        raw = data.tobytes()
        fold = self.folds and not any(head in raw for head in self.heads)
        # One more byte of white space after each text.
        data = np.insert(data, at[1:], 32)
        ends_of_texts = at[1:] + np.arange(1, len(at))
        if fold:
            data |= (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
        starts, ends = _words(data)
        if fold and self.letters is LETTERS:
            # A word of its own for two or more signs that end a word after a letter.
            double = np.flatnonzero((ends - starts > 2) & SIGNS[data[ends - 1]] & SIGNS[data[np.maximum(ends - 2, 0)]])
            if len(double):
                last = _before_signs(data, ends[double])
                cut = (last >= starts[double]) & (data[last] >= 97) & (data[last] <= 122)
                double, cuts = double[cut], last[cut] + 1
                starts, ends = np.insert(starts, double + 1, cuts), np.insert(ends, double, cuts)
        tails = np.zeros(len(ends), np.int64)
        if fold:
            last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
            core = (ends - starts > 1) & (before >= 97) & (before <= 122)
            tails = np.where(core & (last == ord(",")), 1, np.where(core & (last == ord(".")), 2, 0))
        found = self._look_up(data, starts, ends - starts - (tails > 0))
        entries = np.stack((found, tails), axis=1).ravel()
        ids = self._gather(entries[entries > 0])
        upto = np.cumsum(self.lengths.take(found) + self.lengths.take(tails), dtype=np.int64)
        tokens_upto = np.concatenate(([0], upto))[np.searchsorted(starts, ends_of_texts)]
        return np.insert(ids, tokens_upto, self.end_id), np.diff(tokens_upto, prepend=0) + 1


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encode(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.get((path, end_id)) or _encoders.setdefault((path, end_id), WordEncoder(path, end_id))
    part, before = TaskContext.get().partitionId(), 0
    for batch in pieces(batches, PIECE):
        ids, counts = encoder.encode(*flat(batch["text"]))
        upto = np.cumsum(counts)
        offsets = np.concatenate(([0], upto)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(np.full(len(counts), part, np.int32)),
                pa.array(before + upto - counts),
                pa.array(counts),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
            ],
            names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
        )
        before += int(upto[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode ``docs`` (``doc_id, text``) into ORC files under ``path``, in ascending order of ``doc_id``.

    Rows: ``doc_id, part, start_in_part, n_tokens, ids``, where ``part`` numbers the files in
    order and ``start_in_part`` counts the ids before the row in its file. One range shuffle of
    the texts; ids are made afterwards and not shuffled. ``tokenizer`` is the file of a tokenizer that
    drops white space, on every executor.

    A null or empty text is its end id alone. Null ids come first. Rows of equal id are in order of
    a hash of their texts, and equal rows may be spread over files. Extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"), spread.alias("spread"))
    keys = ["doc_id", "copy", "spread"]
    encoded = (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(
            lambda batches: _encode(batches, tokenizer, end_id),
            f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids array<int>",
        )
    )
    encoded.write.options(**LAYOUT).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files. Files are read by stripes; a filter on ``doc_id`` skips stripes and
    groups of rows by their statistics and Bloom filters, and columns left out are not read."""
    return spark.read.orc(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Rows of token files with ``start``, the number of ids of all rows before them."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    few = tokens.select("part").agg(F.max("part")).first()[0]
    if few is None or few < MAX_BROADCAST_PARTS:
        totals = F.broadcast(totals)
    return tokens.join(totals, "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        data = np.asarray(ids.values).astype("<u4", copy=False)
        at = np.asarray(ids.offsets).tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_index(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the rows of token files."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = with_starts(tokens).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_checksums, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write token files to the shared folder, and the index of what they hold when read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_index(read_tokens(docs.sparkSession, path))
