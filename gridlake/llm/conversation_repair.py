"""Repair of the structure of conversations by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANK = " \t\n\x0b\x0c\r"

# Turns that are searched at once. Longer conversations are searched piece by piece.
PIECE = 16

# What a conversation has had last: nothing, the system's turn, the user's, or the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
# The role of an inserted or changed turn, by what came before it.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_AFTER = {"user": USER, "assistant": ASSISTANT}
# The initials that may stay after a state, and what they lead to.
_KEEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_GOOD = frozenset({("s", "u"), ("u", "a"), ("a", "u")})


@dataclass
class Turn:
    role: str
    text: str
    fault: str  # "blank", "duplicate", "truncated" or none

    @property
    def initial(self) -> str:
        return self.role[:1]

    @property
    def forced(self) -> bool:
        return self.fault in ("blank", "duplicate")


def least_costs(turns: list[Turn]) -> list[int]:
    """A lower bound of the cost of the turns from each position on.

    Blank turns and duplicates have to be deleted, and truncated ones cost 1 or more. Besides, each
    edit mends two neighbours of wrong roles at most and costs 2 or more beyond that, so each pair
    of wrong neighbours, among turns that need not go, costs 1 or more.
    """
    costs = [0] * (len(turns) + 1)
    following = None
    for i in range(len(turns) - 1, -1, -1):
        turn = turns[i]
        if turn.forced:
            costs[i] = costs[i + 1] + DELETE
            continue
        costs[i] = costs[i + 1] + (TRUNCATED if turn.fault else 0)
        if following is not None and (turn.initial, following) not in _GOOD:
            costs[i] += 1
        following = turn.initial
    return costs


class Search:
    """Cheapest edits of some turns, from a state to an accepted one.

    Depth-first in ASCII order of the edits' initials, under a bound on the cost that grows until a
    path is found: the first one found is the cheapest, and the ASCII-least of the cheapest. The table
    of failed states holds what is left to spend from each at the least: where it failed, that is the
    least that any of its edits needs. States are not entered with less, and the table serves all bounds
    and all states to start from.
    """

    def __init__(self, turns: list[Turn], accepted: frozenset[int]) -> None:
        self.turns = turns
        self.accepted = accepted
        rest = least_costs(turns)
        self.failed = [rest[:-1] + [0 if state in accepted else INSERT] for state in range(4)]
        self.path: list[str] = []

    def find(self, start: int) -> tuple[int, str, int] | None:
        """Cost, edits and last state, or ``None`` if no accepted state can be reached."""
        needs = self.failed[start]
        # Deleting all and inserting two turns reaches whatever can be reached.
        while (bound := needs[0]) <= DELETE * len(self.turns) + 2 * INSERT:
            self.path.clear()
            if (found := self._enter(0, start, bound)) is not None:
                return bound, "".join(self.path), found
        return None

    def _enter(self, i: int, state: int, left: int) -> int | None:
        """The accepted state that the first path within ``left`` leads to; its edits are in ``path``."""
        more = i < len(self.turns)
        if not more and state in self.accepted:
            return state
        role = _AFTER[NEXT[state]]
        edits = [("I", INSERT, i, role)]
        if more:
            turn = self.turns[i]
            edits.insert(0, ("D", DELETE, i + 1, state))
            if not turn.forced:
                extra = TRUNCATED if turn.fault else 0
                kept = _KEEP[state].get(turn.initial)
                if kept is not None:
                    edits.append(("K", extra, i + 1, kept))
                edits.append(("R", REROLE + extra, i + 1, role))
        for letter, cost, to, after in edits:
            if cost + self.failed[after][to] <= left:
                self.path.append(letter)
                if (found := self._enter(to, after, left - cost)) is not None:
                    return found
                self.path.pop()
        self.failed[state][i] = min(cost + self.failed[after][to] for _, cost, to, after in edits)
        return None


def edited(turns: Iterable[Turn], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each turn that the edits leave, from ``state`` on."""
    rows = iter(turns)
    for letter in audit:
        turn = None if letter == "I" else next(rows)
        if letter == "D":
            continue
        role = turn.role if letter == "K" else NEXT[state]
        state = _KEEP[state][role[:1]]
        yield letter, role, turn.text if turn else ""


@dataclass
class _Path:
    """Edits that lead to one state after some pieces, and the hash of what they leave."""

    cost: int = 0
    audit: str = ""
    hash: object = field(default_factory=hashlib.sha256)
    any: bool = False

    def extended(self, turns: list[Turn], cost: int, audit: str, state: int) -> _Path:
        out = _Path(self.cost + cost, self.audit + audit, self.hash.copy(), self.any)
        for _, role, text in edited(turns, audit, state):
            out.hash.update(f"{chr(10) if out.any else ''}{role}:{text}".encode())
            out.any = True
        return out


def _through(paths: dict[int, _Path], turns: list[Turn]) -> dict[int, _Path]:
    """The best path to each state after one more piece.

    Paths of the same cost between the same states are never the beginning of one another, so the
    least path to a state begins with the least paths to the states before.
    """
    system = any(t.initial == "s" and not t.forced for t in turns)
    best: dict[int, tuple] = {}
    for end in range(4):
        search = Search(turns, frozenset({end}))
        for start, path in paths.items():
            if end == START != start or end == SYSTEM and not (start == SYSTEM or start == START and system):
                continue
            found = search.find(start)
            key = (path.cost + found[0], path.audit + found[1])
            if end not in best or key < best[end][0]:
                best[end] = (key, start, found)
    return {end: paths[s].extended(turns, f[0], f[1], s) for end, (_, s, f) in best.items()}


def _last(paths: dict[int, _Path], turns: list[Turn]) -> _Path:
    search = Search(turns, frozenset({START, ASSISTANT}))
    best = None
    for start, path in paths.items():
        found = search.find(start)
        key = (path.cost + found[0], path.audit + found[1])
        if best is None or key < best[0]:
            best = (key, start, found)
    _, start, found = best
    return paths[start].extended(turns, found[0], found[1], start)


class _Conversation:
    """One conversation, turn by turn; it holds one piece of turns, and the edits so far."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.distinct = 0
        self.first = self.latest = None
        self.before: str | None = None
        self.piece: list[Turn] = []
        self.paths = {START: _Path()}

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.distinct += self.latest is None or turn != self.latest
            self.first = turn if self.first is None else self.first
            self.latest = turn
        end = text.rstrip(BLANK)
        fault = "blank" if not end else "duplicate" if seen else "" if end[-1] in ".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.before is not None and (self.before, role[:1]) not in _GOOD:
            self.counts["illegal"] += 1
        self.before = role[:1]
        if len(self.piece) == PIECE:
            self.paths = _through(self.paths, self.piece)
            self.piece = []
        self.piece.append(Turn(role, text, fault))

    def result(self) -> tuple:
        path = _last(self.paths, self.piece)
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.distinct
        return gaps, *self.counts.values(), path.cost, path.audit, path.hash.hexdigest()


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[name].to_pylist() for name in names])


def _repair(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        ids, *columns = zip(*out)
        kinds = [*[pa.int64()] * len(_LONGS), pa.string(), pa.string()]
        arrays = [pa.array(ids, kind), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_LONGS, "audit", "repaired_sha256"])

    names = ["conv_id", "turn", "role", "text", "seen"]
    for conv_id, rows in groupby(_rows(batches, names), key=lambda row: row[0]):
        conversation = _Conversation()
        for _, turn, role, text, seen in rows:
            if role is not None:
                conversation.add(turn, role, text, seen)
        out.append((conv_id, *conversation.result()))
        size += 100 + len(out[-1][-2])
        if size > 1 << 20:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _filled(turns: DataFrame) -> DataFrame:
    absent = F.col("role").isNull() & F.col("text").isNull()
    fill = lambda name: F.when(~absent, F.coalesce(name, F.lit(" "))).alias(name)
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), fill("role"), fill("text"))


def repair(turns: DataFrame) -> DataFrame:
    """Faults of each conversation and its cheapest repair: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. A conversation's rows are
    taken by turn, nulls first, then by role and text. A row's first fault counts: blank, duplicate (the
    role and text of an earlier row), truncated (the last character that is not white space is none of
    ``.!?``). Repaired roles are nothing, or turns of user and assistant in turn after at most one of the
    system. Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank
    rows and duplicates), Insert an empty turn 2; a truncated row that stays costs 1. ``audit`` has the
    cheapest edits' initials, the ASCII-least if several cost the same. ``repaired_sha256`` is the hash
    of the repaired ``role:text``, joined by newlines.

    A null role or text counts as one space, as it does where an empty role cannot stay. A row where both
    are null is no turn, but its conversation is returned: without turns it has zeros, no edits and the
    hash of nothing. Rows without ``conv_id`` are one conversation. No rows give no rows.

    The turns are shuffled once, by conversation, and streamed through its task in order: it holds
    ``PIECE`` turns, and up to four lists of edits with the states of their hashes. So a conversation of
    any length needs memory for its edits only; its hash has to be taken in one task.
    """
    schema = turns.schema["conv_id"].dataType
    by_conversation = _filled(turns).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = by_conversation.withColumn("seen", F.row_number().over(earlier) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    out = ", ".join([f"conv_id {schema.simpleString()}", *[f"{n} bigint" for n in _LONGS], "audit string, repaired_sha256 string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            yield from _repair(_chain(first, batches), first.schema.field("conv_id").type)

    return ordered.mapInArrow(run, out)


def _chain(first: pa.RecordBatch, others: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from others


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "audit", "role", "text"]
    for first in batches:
        kind = first.schema.field("conv_id").type
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ids, *columns = zip(*out)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(ids, kind), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "position", "edit", "role", "text"])

        for conv_id, rows in groupby(_rows(_chain(first, batches), names), key=lambda row: row[0]):
            audit = next(rows)[1]
            turns = (Turn(role, text, "") for _, _, role, text in rows if role is not None)
            for position, row in enumerate(edited(turns, audit, START)):
                out.append((conv_id, position, *row))
                size += 50 + len(row[-1])
                if size > 1 << 22:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, role, text``, positions from 0.

    The edits of ``repair`` are applied to the same rows in the same order, in a stream as well.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = repair(turns).select(
        "conv_id", "audit", *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("text", "string"))]
    )
    rows = found.unionByName(_filled(turns).withColumn("audit", F.lit(None).cast("string")))
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text"
    )
    return ordered.mapInArrow(_apply, f"conv_id {kind}, position bigint, edit string, role string, text string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, by ``crc32(conv_id:turn) % 20``.

    0 drops the row (its role and text become null), 1 empties the text, 2 removes its ``.!?``, 3
    repeats the row, 4 sets the role ``user``. Nulls in role and text, and in what is hashed, count as
    one space.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)

    def when(kind: int, new: Column, old: Column) -> Column:
        return F.when(fault == kind, new).otherwise(old)

    nothing = F.lit(None).cast("string")
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    changed = turns.select(
        "conv_id",
        "turn",
        when(0, nothing, when(4, F.lit("user"), role)).alias("role"),
        when(0, nothing, when(1, F.lit(""), when(2, F.translate(text, ".!?", ""), text))).alias("text"),
        F.explode(copies).alias("copy"),
    )
    return changed.drop("copy")
