"""Near-duplicates by the Jaccard similarity of shingle sets: an exact join over prefix trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import pieces, raw_texts, stored
from gridlake.llm.simhash import components

# The part of all shingles, by hash, that the first look takes.
LOOK = 0.3
_LOOK = int(-(2**63) + LOOK * 2**64)
# Shingles of one tree; more of them in one group of candidates are dealt over several.
TREE = 1 << 20
# One in so many sets of one tree of a large group is in each of its trees, so that what links meets.
PIVOT = 64
# Rows of numbers that are sent to all executors; of more, both sides of the join are shuffled.
FEW = 1 << 21
# Bytes of a text that are looked at at once, and sets that a task remembers having seen.
_BLOCK, _SEEN = 1 << 18, 1 << 18

# --- sets of shingles ----------------------------------------------------------------------------


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Words are hashed as polynomials: a number for each byte, times powers of an odd base.
_BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _powers(base: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(_BLOCK, base, np.uint64))))


def _mixed(value: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    value = (value ^ lengths.astype(np.uint64)) * _FACTOR
    return value ^ (value >> np.uint64(29))


def word_hashes(text: bytes, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each word of a text; A-Z are lower-cased.

    The text is taken in blocks, and a word that goes on into the next one is carried over, so memory
    does not grow with the text but for the hashes.
    """
    up, down = powers
    out = []
    carried, length = 0, 0
    for at in range(0, len(text), _BLOCK):
        block = np.frombuffer(text[at : at + _BLOCK].translate(_LOWER), np.uint8)
        gap = np.ones(len(block) + 2, bool)
        gap[1:-1] = _SPACE[block]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[block] * up[: len(block)])))
        values = (sums[ends] - sums[starts]) * down[starts]
        lengths = ends - starts
        if length and len(starts) and starts[0] == 0:
            values[0] = (carried + int(values[0]) * pow(_BASE, length, 1 << 64)) % (1 << 64)
            lengths[0] += length
        elif length:
            out.append(_mixed(np.array([carried], np.uint64), np.array([length])))
        length = 0
        if len(ends) and ends[-1] == len(block):
            carried, length = int(values[-1]), int(lengths[-1])
            values, lengths = values[:-1], lengths[:-1]
        out.append(_mixed(values, lengths))
    if length:
        out.append(_mixed(np.array([carried], np.uint64), np.array([length])))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def shingles(text: bytes, words: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of ``words`` words of a text.

    Words are separated by ASCII white space. Fewer words are one shingle, no words none.
    """
    w = word_hashes(text, powers)
    if len(w) == 0:
        return np.zeros(0, np.int64)
    k = min(words, len(w))
    value = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        value = (value ^ w[j : len(w) - k + 1 + j]) * _FACTOR
        value ^= value >> np.uint64(29)
    value = np.sort(value.view(np.int64))
    return value[np.concatenate(([True], value[1:] != value[:-1]))]


def _sets(batches: Iterable[pa.RecordBatch], words: int, look: bool) -> Iterator[pa.RecordBatch]:
    """Sets of the texts of some documents; the tokens of those that this task has not seen before."""
    powers = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    seen: set[bytes] = set()
    for batch in pieces(batches):
        names, sizes, found = [], [], []
        for text in raw_texts(batch["text"]):
            tokens = shingles(text, words, powers)
            names.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            sizes.append(len(tokens))
            if names[-1] in seen:
                tokens = tokens[:0]
            elif len(seen) < _SEEN:
                seen.add(names[-1])
            found.append(tokens[: np.searchsorted(tokens, _LOOK)] if look else tokens)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        keys = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        new = [pa.array(sizes, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), tokens]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch[n] for n in kept] + new, names=[*kept, "n", "h1", "h2", "tokens"])


_SET = "n bigint, h1 bigint, h2 bigint, tokens array<bigint>"


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, text_hash, n, h1, h2, tokens, row`` of each row of ``docs``, written down.

    ``n`` is the number of its distinct shingles, ``h1, h2`` a hash of the set, and ``row`` a number.
    ``tokens`` are the least hashes of its shingles, the part ``LOOK`` of all that there can be; they are
    empty where an earlier row of the same task has the same set.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = rows.mapInArrow(lambda batches: _sets(batches, words, True), f"doc_id {kind}, text_hash bigint, {_SET}")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")


def few(rows: DataFrame) -> DataFrame:
    """``rows`` of a number or two, written down; to be broadcast if they are few enough."""
    rows = stored(rows, "jaccard-rows")
    return F.broadcast(rows) if rows.count() <= FEW else rows


# --- the join within one tree --------------------------------------------------------------------


def least_common(n: int, percent: int) -> int:
    """The least intersection of a set of ``n`` with any that links to it."""
    return -(-percent * n // 100)


class Tree:
    """Sets of globally ordered tokens as a trie with its single paths contracted.

    ``order`` has the sets in lexicographic order; a node stands for a range of it whose sets share
    their first ``depth`` tokens.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray) -> None:
        m = len(sequences)
        keys = [s.astype(">u4").tobytes() for s in sequences]
        self.order = sorted(range(m), key=keys.__getitem__)
        self.sequences = [sequences[k] for k in self.order]
        # Nodes: first set, tokens shared, children and their first sets; and, over the sets of a node,
        # the least size and the greatest number of tokens. The first nodes are the sets themselves.
        self.low = list(range(m))
        self.depth = [len(s) for s in self.sequences]
        self.least = [int(sizes[k]) for k in self.order]
        self.longest = list(self.depth)
        self.children: list[list[int]] = [[] for _ in range(m)]
        self.starts: list[np.ndarray | None] = [None] * m
        self.root = self._node(0, 0)
        open_nodes = [self.root]
        for i in range(1, m + 1):
            shared = self._shared(i) if i < m else 0
            child = i - 1
            while self.depth[open_nodes[-1]] > shared:
                node = open_nodes.pop()
                self.children[node].append(child)
                self._close(node)
                child = node
            if self.depth[open_nodes[-1]] < shared:
                open_nodes.append(self._node(self.low[child], shared))
            self.children[open_nodes[-1]].append(child)
        self._close(self.root)

    def _node(self, low: int, depth: int) -> int:
        for values, value in ((self.low, low), (self.depth, depth), (self.least, 0), (self.longest, 0), (self.children, []), (self.starts, None)):
            values.append(value)
        return len(self.low) - 1

    def _close(self, node: int) -> None:
        below = self.children[node]
        self.starts[node] = np.array([self.low[c] for c in below])
        self.least[node] = min(self.least[c] for c in below)
        self.longest[node] = max(self.longest[c] for c in below)

    def _shared(self, i: int) -> int:
        a, b = self.sequences[i - 1], self.sequences[i]
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n


def linked(sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int, all_pairs: bool) -> list[tuple[int, int, int]]:
    """Pairs of sets that link, as positions, with the size of their intersection.

    ``sets`` are ascending ranks of tokens in the global order, of the tokens that other sets may have;
    ``sizes`` count all tokens. For each set the tree is traversed with its tokens marked. The overlap
    with a path is counted once for all sets below it, and a subtree is left out if what remains of the
    path or of the set cannot bring the overlap to what the smallest set below needs. Only subtrees are
    entered that have a set with a common token among the first of both, since what links has one.

    With ``all_pairs`` every pair is returned. Otherwise pairs whose sets are connected already, by
    earlier pairs or by equal ``labels``, are passed over: the rest connect all that link.
    """
    m = len(sets)
    if m < 2:
        return []
    tree = Tree(sets, sizes)
    order = np.array(tree.order)
    sizes = sizes[order]
    sequences = tree.sequences
    # Numbers of labels, so that connecting two means renaming the sets of the smaller one.
    label = np.unique(labels[order], return_inverse=True)[1]
    by_label = np.argsort(label, kind="stable")
    bounds = np.searchsorted(label[by_label], np.arange(label.max() + 2))
    members = {k: by_label[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)}

    # Where each token is among the first tokens of a set.
    firsts = [s[: max(0, len(s) - least_common(int(n), percent) + 1)] for s, n in zip(sequences, sizes)]
    tokens = np.concatenate(firsts)
    at = np.repeat(np.arange(m), [len(f) for f in firsts])
    by_token = np.lexsort((at, tokens))
    vocabulary = max(int(s[-1]) for s in sequences) + 1
    places = at[by_token]
    bounds = np.searchsorted(tokens[by_token], np.arange(vocabulary + 1))
    last = np.full(vocabulary, -1)
    some = bounds[1:] > bounds[:-1]
    last[some] = places[bounds[1:][some] - 1]
    settled = np.zeros(vocabulary, bool)

    marked = np.zeros(vocabulary, bool)
    out: list[tuple[int, int, int]] = []
    for q in range(m):
        mine = firsts[q]
        mine = mine[(last[mine] > q) & ~settled[mine]]
        if len(mine) == 0:
            continue
        near = []
        for token in mine.tolist():
            having = places[bounds[token] : bounds[token + 1]]
            if not all_pairs and (label[having] == label[having[0]]).all():
                settled[token] = True
            else:
                near.append(having[np.searchsorted(having, q, "right") :])
        if not near:
            continue
        wanted = np.unique(np.concatenate(near))
        n = int(sizes[q])
        fits = (percent * np.maximum(sizes[wanted], n) <= 100 * np.minimum(sizes[wanted], n)) & (all_pairs | (label[wanted] != label[q]))
        wanted = wanted[fits]
        if len(wanted) == 0:
            continue
        y = sequences[q]
        marked[y] = True
        entered = [(tree.root, 0, wanted)]
        while entered:
            node, overlap, wanted = entered.pop()
            depth = tree.depth[node]
            # Sets are in the order of the tree: those wanted below a child are a range.
            which = np.searchsorted(tree.starts[node], wanted, "right") - 1
            for below in np.split(wanted, np.flatnonzero(np.diff(which)) + 1):
                if not all_pairs and (label[below] == label[q]).all():
                    continue
                child = tree.children[node][which[np.searchsorted(wanted, below[0])]]
                edge = sequences[below[0]][depth : tree.depth[child]]
                common = overlap + int(np.count_nonzero(marked[edge]))
                if tree.children[child]:
                    rest = tree.longest[child] - tree.depth[child]
                    if len(edge):
                        rest = min(rest, len(y) - int(np.searchsorted(y, edge[-1], "right")))
                    if (common + rest) * (100 + percent) >= percent * (n + max(tree.least[child], least_common(n, percent))):
                        entered.append((child, common, below))
                elif common * (100 + percent) >= percent * (n + int(sizes[child])):
                    out.append((int(order[q]), int(order[child]), common))
                    one, two = int(label[q]), int(label[child])
                    if not all_pairs:
                        if len(members[one]) < len(members[two]):
                            one, two = two, one
                        label[members[two]] = one
                        members[one] = np.concatenate([members[one], members.pop(two)])
        marked[y] = False
    return out


def _join(table: pa.Table, percent: int, all_pairs: bool) -> pa.Table:
    items = table["items"].combine_chunks()
    ends = items.offsets.to_numpy() - items.offsets[0].as_py()
    inner = items.flatten()
    tokens, counts = (inner.field(name).to_numpy() for name in ("token", "df"))
    order = np.lexsort((tokens, counts))
    new = np.ones(len(order), np.int64)
    new[1:] = tokens[order[1:]] != tokens[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    rows = table["row"].to_numpy()
    sets = [ranks[a:b] for a, b in zip(ends, ends[1:])]
    pairs = linked(sets, table["n"].to_numpy(), table["label"].to_numpy(), percent, all_pairs)
    found = np.array(pairs, np.int64).reshape(-1, 3)
    one, two = rows[found[:, 0]], rows[found[:, 1]]
    return pa.table({"u": np.minimum(one, two), "v": np.maximum(one, two), "common": found[:, 2]})


# --- the join of all sets ------------------------------------------------------------------------


def _needed(n: Column, percent: int) -> Column:
    return F.call_function("div", n * percent + 99, F.lit(100))


def _linkable(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``row`` of the classes that may link, by a part of the shingles.

    A set that links has at most ``n - needed`` shingles that no other set has. So whatever has more of
    those among the shingles with the least hashes is left out.
    """
    repeats = few(sets.select("row").join(classes.select("row"), "row", "left_anti"))
    firsts = sets.join(repeats, "row", "left_anti")
    some = firsts.select("row", F.explode("tokens").alias("token"))
    often = stored(some.groupBy("token").count().where("count > 1").select("token"), "jaccard-look")
    shared = some.join(often, "token", "left_semi").groupBy("row").agg(F.count("*").alias("shared"))
    counted = firsts.where("n > 0").select("row", "n", F.size("tokens").alias("seen")).join(shared, "row", "left")
    alone = F.col("seen") - F.coalesce("shared", F.lit(0))
    return counted.where(alone <= F.col("n") - _needed(F.col("n"), percent)).select("row")


def _whole(docs: DataFrame, sets: DataFrame, rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``row, n, tokens``, written down: all shingles of the classes ``rows``, from the texts again."""
    wanted = few(sets.join(few(rows), "row", "left_semi").select("text_hash").distinct())
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash", "left_semi").select("text")
    found = texts.mapInArrow(lambda batches: _sets(batches, words, False), _SET).where(F.size("tokens") > 0)
    numbered = found.join(few(classes.join(rows, "row", "left_semi").select("h1", "h2", "row")), ["h1", "h2"])
    return stored(numbered.select("row", "n", "tokens").dropDuplicates(["row"]), "jaccard-whole")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """``row, n, items, firsts``: shared tokens in the global order, rare ones first, and how many of
    them an intersection must begin with.

    Tokens that no other set has come first in the order. They cannot be common, so only their number
    counts; a set whose first tokens are all of that kind does not link and is left out.
    """
    tokens = sets.select("row", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    often = stored(often, "jaccard-tokens")
    items = tokens.join(often, "token").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("items"))
    firsts = F.size("items") - _needed(F.col("n"), percent) + 1
    return stored(items.withColumn("firsts", firsts.cast("int")).where("firsts > 0"), "jaccard-ordered")


def _candidates(ordered: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """``row, root`` of sets that share first tokens with others, directly or through more of them.

    Each token ties its sets to the smallest one: rows for each set and token, not for each pair.
    """
    index = ordered.select("row", F.explode(F.expr("slice(items.token, 1, firsts)")).alias("token"))
    if tokens is not None:
        index = index.join(tokens, "token", "left_semi")
    low = index.groupBy("token").agg(F.min("row").alias("u"), F.max("row").alias("high")).where("u < high")
    edges = index.join(low.select("token", "u"), "token").where("u < row").select("u", F.col("row").alias("v")).distinct()
    return stored(components(edges).select(F.col("node").alias("row"), "root"), "jaccard-candidates")


def _trees(rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Links within each tree of ``tree, row, n, items, label``, written down."""
    found = rows.select("tree", "row", "n", "label", "items").groupBy("tree").applyInArrow(
        lambda table: _join(table, percent, all_pairs), "u bigint, v bigint, common bigint"
    )
    return stored(found, "jaccard-links")


def _links(ordered: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """``u, v, common``: linked sets; all of them, or as many as connect all that link.

    What links is in one group of candidates. Groups are dealt over trees of bounded size. A group that
    is too large for one is first dealt by hash over several, each with the same few sets of it besides:
    that connects what is dense. Then only the tokens count whose sets are not connected yet. They make
    smaller groups; one that is still too large is joined by a tree for each two of its parts.
    """
    labels = ordered.select("row", F.col("row").alias("label"))
    open_tokens, found = None, None
    for last in (False, True):
        roots = _candidates(ordered, open_tokens)
        groups = ordered.join(roots, "row")
        weight = groups.groupBy("root").agg(F.sum(F.size("items")).alias("weight"))
        weight = weight.withColumn("parts", F.ceil(F.col("weight") / TREE).cast("int"))
        weight = stored(weight, "jaccard-groups")
        total, most = weight.agg(F.sum("weight"), F.max("parts")).first()
        if not total:
            break
        rows = groups.join(weight.select("root", "parts"), "root").join(labels, "row")
        none = F.lit(0).cast("bigint")
        bucket = F.pmod(F.xxhash64("root"), F.lit(-(-2 * total // TREE)))
        small = rows.where("parts = 1").withColumn("tree", F.struct((none - 1).alias("root"), bucket.alias("a"), none.alias("b")))
        large = rows.where("parts > 1")
        part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("bigint")
        parts = F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)

        def dealt(trees: Column) -> DataFrame:
            root = F.col("root")
            return large.withColumn("tree", F.explode(F.transform(trees, lambda t: F.struct(root, t["a"].alias("a"), t["b"].alias("b")))))

        if last or all_pairs:
            # Each two parts have a tree, where the sets of both are.
            both = F.transform(parts, lambda p: F.struct(F.least(p, part).alias("a"), F.greatest(p, part).alias("b")))
            rows = small.unionByName(dealt(both))
        else:
            pivot = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts") * PIVOT) == 0
            own = F.struct(part.alias("a"), none.alias("b"))
            every = F.transform(parts, lambda p: F.struct(p.alias("a"), none.alias("b")))
            rows = small.unionByName(dealt(F.when(pivot, every).otherwise(F.array(own))))
        fresh = _trees(rows, percent, all_pairs)
        if all_pairs:
            return fresh.distinct()
        found = fresh if found is None else found.unionByName(fresh)
        if most == 1 or last:
            break
        # Tokens of large groups with sets that are not connected.
        joined = components(found.select("u", "v")).withColumnsRenamed({"node": "row", "root": "label"})
        labels = ordered.select("row").join(joined, "row", "left").select("row", F.coalesce("label", "row").alias("label"))
        labels = stored(labels, "jaccard-labels")
        ordered = stored(ordered.join(large.select("row"), "row", "left_semi"), "jaccard-large")
        index = ordered.select("row", F.explode(F.expr("slice(items.token, 1, firsts)")).alias("token")).join(labels, "row")
        open_tokens = index.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
        open_tokens = stored(open_tokens, "jaccard-open")
    return found


def _classes(sets: DataFrame) -> DataFrame:
    """``h1, h2, row, doc_id``: each set once, under its first row and the smallest id that has it."""
    whole = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"))
    return stored(whole, "jaccard-classes")


def _found(docs: DataFrame, sets: DataFrame, classes: DataFrame, words: int, percent: int, all_pairs: bool) -> DataFrame | None:
    rows = stored(_linkable(sets, classes, percent), "jaccard-linkable")
    return _links(_ordered(_whole(docs, sets, rows, classes, words), percent), percent, all_pairs)


def similar_sets(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links, and which documents they are between.

    The first frame has ``u, v, common``: classes, each a set of shingles, whose intersection ``common``
    is ``percent`` or more of their union. The second has ``doc_id, n, class`` for each row of ``docs``;
    the class of a document without words is null.
    """
    sets = shingle_sets(docs, words)
    classes = _classes(sets)
    pairs = _found(docs, sets, classes, words, percent, True)
    if pairs is None:
        pairs = sets.sparkSession.createDataFrame([], "u bigint, v bigint, common bigint")
    members = sets.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", F.col("row").alias("class")), ["h1", "h2"], "left")
    return pairs, members.select("doc_id", "n", "class")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (``doc_id, text``).

    A document's set has its distinct shingles of ``words`` words; two documents link if the
    intersection of their sets is ``percent`` hundredths of the union or more. A component is what links
    reach, and is named by its smallest id.

    Shingles are compared by 64-bit hashes. A null or empty text, or one without words, has no shingles
    and is a component by itself. Null ids do not name a component; one without other ids has a null
    name. Repeated rows each get their row. No rows give no rows. Extra columns are ignored.
    """
    sets = shingle_sets(docs, words)
    classes = _classes(sets)
    links = _found(docs, sets, classes, words, percent, False)
    if links is not None:
        roots = components(links.select("u", "v")).withColumnRenamed("node", "row")
        named = classes.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        classes = stored(named.join(first, "root").select("h1", "h2", "component_id"), "jaccard-components")
    else:
        classes = classes.select("h1", "h2", F.col("doc_id").alias("component_id"))
    rows = sets.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
