import hashlib
import random
import re
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F
from samples import remainder, table

from gridlake.llm import conversation_repair as cr

GOOD = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        k = remainder(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}", 20)
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    out = []
    for k, (_, role, text) in enumerate(rows):
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        seen = (role, text) in [r[1:] for r in rows[:k]]
        out.append("blank" if not end else "duplicate" if seen else "" if end[-1] in ".!?" else "truncated")
    return out


def automaton(q, initial):
    return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[q].get(initial)


def by_costs_to_go(rows, kinds):
    """Cheapest edits, ASCII-least, from the exact cost of what is left in each state."""
    n = len(rows)
    costs = {(n, q): (0 if q in ("", "a") else 2 if q == "u" else 4) for q in ("", "s", "u", "a")}

    def options(i, q):
        role = "assistant" if q == "u" else "user"
        if i < n:
            yield "D", 3, i + 1, q, None
        yield "I", 2, i, role[0], (role, "")
        if i < n and kinds[i] not in ("blank", "duplicate"):
            extra = 1 if kinds[i] else 0
            if to := automaton(q, rows[i][1][:1]):
                yield "K", extra, i + 1, to, rows[i][1:]
            yield "R", 2 + extra, i + 1, role[0], (role, rows[i][2])

    for i in range(n - 1, -1, -1):
        for q in ("", "s", "u", "a"):
            costs[i, q] = 10**9
        for _ in range(4):  # inserts lead from one state to another at the same row
            for q in ("", "s", "u", "a"):
                costs[i, q] = min(c + costs[j, to] for _, c, j, to, _ in options(i, q) if (j, to) in costs)
    i, q, audit, left = 0, "", "", []
    while not (i == n and q in ("", "a")):
        for letter, c, j, to, row in options(i, q):
            if c + costs[j, to] == costs[i, q]:
                audit, i, q = audit + letter, j, to
                left += [row] if row else []
                break
    return costs[0, ""], audit, left


def by_enumeration(rows, kinds):
    best = None
    for inserts in range(len(rows) + 3):
        for word in product("DIKR", repeat=len(rows) + inserts):
            if word.count("I") != inserts:
                continue
            cost, k, q, ok = 0, 0, "", True
            for letter in word:
                if letter == "I":
                    cost, q = cost + 2, automaton(q, "a" if q == "u" else "u")
                    continue
                kind, initial = kinds[k], rows[k][1][:1]
                k += 1
                if letter == "D":
                    cost += 3
                    continue
                q = automaton(q, initial if letter == "K" else "a" if q == "u" else "u")
                cost += (2 if letter == "R" else 0) + (kind == "truncated")
                ok = kind not in ("blank", "duplicate")
                if q is None or not ok:
                    ok = False
                    break
            if ok and q in ("", "a"):
                best = min(best or (cost, "".join(word)), (cost, "".join(word)))
    return best


def expected(rows):
    kinds = faults(rows)
    cost, audit, left = by_costs_to_go(rows, kinds)
    assert GOOD.fullmatch("".join(role[0] for role, _ in left))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest), left


def conversation(rng, n):
    rows = []
    for turn in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
        text = rng.choice(["", " \t", "Yes.", "No", f"line {turn}!", f"cut {turn}", "Same."])
        rows.append((turn, role, text))
    return sorted(rows)


def turns_of(rows):
    return [cr.Turn(role, text, kind) for (_, role, text), kind in zip(rows, faults(rows))]


def test_search_against_exact_costs():
    rng = random.Random(1)
    for _ in range(400):
        rows = conversation(rng, rng.randint(0, 14))
        found = cr.Search(turns_of(rows), frozenset({cr.START, cr.ASSISTANT})).find(cr.START)
        cost, audit, left = by_costs_to_go(rows, faults(rows))
        assert found[:2] == (cost, audit)
        assert [(r, t) for _, r, t in cr.edited(turns_of(rows), audit, cr.START)] == left
        assert cr.least_costs(turns_of(rows))[0] <= cost


def test_search_against_all_edits():
    rng = random.Random(2)
    for _ in range(25):
        rows = conversation(rng, rng.randint(0, 3))
        assert cr.Search(turns_of(rows), frozenset({cr.START, cr.ASSISTANT})).find(cr.START)[:2] == by_enumeration(rows, faults(rows))


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_give_the_same_edits(monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rng = random.Random(3)
    for _ in range(150):
        rows = conversation(rng, rng.randint(0, 16))
        one = cr._Conversation()
        for (turn, role, text), kind in zip(rows, faults(rows)):
            one.add(turn, role, text, kind == "duplicate")
        assert one.result() == expected(rows)[0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def check(spark, rows):
    df = cr.damage(frame(spark, rows).withColumns({n: F.lit("x") for n in ("audit", "seen", "copy", "position", "edit")}))
    want = {c: expected(v) for c, v in damaged(rows).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair(df).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    left = defaultdict(list)
    for r in sorted(cr.repaired_turns(df).collect(), key=lambda r: r["position"]):
        left[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(left) == {c: w[1] for c, w in want.items() if w[1]}


def test_whole_table(spark):
    check(spark, [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")])


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(7, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(300)]
    rows += [(8, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Ja.", "no", ""])) for t in range(130)]
    rows += [(None, 1, "user", "x" * 300_000), (None, None, None, None), (None, None, "user", "Hm."), (9, None, None, None)]
    rows += [(10, 3, "user", "Twice."), (10, 3, "user", "Twice."), (10, 9, "assistant", "größer 🙂!"), (10, None, "", "Empty role.")]
    check(spark, rows)
    assert cr.repair(frame(spark, [])).collect() == []
    dropped = next(k for k in range(1000) if remainder(f"{k}:0", 20) == 0)
    check(spark, [(dropped, 0, "user", "Gone.")])
