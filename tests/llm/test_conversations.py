"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import functools
import random
import re

import pytest

from factloom.llm.conversations import damage, repair, repaired_digests

LEGAL = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
GIVEN = (("u", "user"), ("a", "assistant"))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        s = text.rstrip(" \t\n\x0b\f\r")
        out.append((role, text, "b" if not s else "d" if (role, text) in seen else "t" if s[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def exhaustive(rows, inserts=3):
    """Every sequence of edits with a few insertions: the least (cost, audit) and its turns."""
    best = [(10**9, "", ())]

    def go(i, cost, audit, out, room):
        if cost > best[0][0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best[0] = min(best[0], (cost, audit, out))
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", out, room)
            if fault not in ("b", "d"):
                late = 3 if fault == "t" else 0
                go(i + 1, cost + late, audit + "K", (*out, (role, text)), room)
                for _, name in GIVEN:
                    go(i + 1, cost + 3 + late, audit + "R", (*out, (name, text)), room)
        for _, name in GIVEN if room else ():
            go(i, cost + 3, audit + "I", (*out, (name, "")), room - 1)

    go(0, 0, "", (), inserts)
    return best[0]


def cheapest(rows):
    """The same by states, for longer conversations, with insertions anywhere."""

    def put(ways, state, way):
        ways[state] = min(ways.get(state, way), way, key=lambda w: w[:2])

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                for initial, name in GIVEN:
                    if (state, initial) in LEGAL:
                        put(ways, LEGAL[state, initial], (cost + 3, audit + "I", (*out, (name, ""))))
        return ways

    ways = {"E": (0, "", ())}
    for role, text, fault in rows:
        old, ways = inserted(ways), {}
        for state, (cost, audit, out) in old.items():
            put(ways, state, (cost + 4, audit + "D", out))
            for letter, initial, name, price in [] if fault in ("b", "d") else [("K", role[:1], role, 0), *(("R", i, n, 3) for i, n in GIVEN)]:
                if (state, initial) in LEGAL:
                    put(ways, LEGAL[state, initial], (cost + price + (3 if fault == "t" else 0), audit + letter, (*out, (name, text))))
    ways = inserted(ways)
    return min((ways[s] for s in "EA" if s in ways), key=lambda w: w[:2])


def plain(turns):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
    found, numbers = faults([r[1:] for r in rows]), [t for t, _, _ in rows if t is not None]
    kinds, initials = [x[2] for x in found], [r[:1] for _, r, _ in rows]
    cost, audit, out = cheapest(found)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t"),
        "illegal": sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired": list(out),
    }


def test_states_find_what_all_edits_find():
    rng = random.Random(5)
    for _ in range(1500):
        rows = faults([(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Hi.", "Yes", "", " ", "No!"])) for _ in range(rng.randint(0, 4))])
        assert cheapest(rows) == exhaustive(rows)


SCHEMA = "conv_id long, turn long, role string, text string"


@functools.cache
def generated():
    rng = random.Random(7)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "", None], ["Hi.", "Yes", "", "Go.", "Yes?", "Be!  ", "No", None, " \n", "x" * 5000 + "."]
    return [(c or None, rng.choice([None, *range(8), 9, 300, 600, 601, -3]), rng.choice(roles), rng.choice(texts)) for c in range(200) for _ in range(rng.randint(1, 12))]


@pytest.mark.parametrize("chunk", [256, 2])
def test_equal_to_the_plain_search(spark, chunk):
    """Nulls everywhere, ties, repeated rows, long and empty texts, folds of one and of several chunks."""
    data = generated()
    got = {r.conv_id: r.asDict() for r in repair(spark.createDataFrame(data, SCHEMA), chunk=chunk).collect()}
    assert set(got) == {d[0] for d in data}
    for c, row in got.items():
        assert {k: [tuple(x) for x in v] if k == "repaired" else v for k, v in row.items() if k != "conv_id"} == plain([d[1:] for d in data if d[0] == c])


def test_long_conversation(spark):
    """Several chunks and thousands of copies of one turn."""
    rng = random.Random(3)
    data = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["A.", "B.", f"C{t}.", f"D{t}"])) for t in range(1500)] + [(1, 700, "user", "Again.")] * 3000
    got = repair(spark.createDataFrame(data, SCHEMA)).collect()[0].asDict()
    want = plain([d[1:] for d in data])
    assert [tuple(x) for x in got.pop("repaired")] == want.pop("repaired")
    assert {k: got[k] for k in want} == want


def test_digests_of_damaged_conversations(spark):
    import hashlib
    import zlib

    data = generated()
    damaged = []
    for c, t, role, text in data:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        damaged += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    table = spark.createDataFrame([(*d, "x") for d in data], SCHEMA + ", n string")
    key = lambda d: tuple("" if x is None else str(x) for x in d)
    assert sorted((tuple(r) for r in damage(table).collect()), key=key) == sorted(damaged, key=key)
    got = {r.conv_id: r for r in repaired_digests(table).collect()}
    assert set(got) == {d[0] for d in data}
    for c, row in got.items():
        want = plain([d[1:] for d in damaged if d[0] == c])
        lines = "\n".join(f"{r}:{x}" for r, x in want.pop("repaired"))
        assert {k: row[k] for k in want} == want
        assert row.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_nothing_left_and_empty_table(spark):
    dropped = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0)
    row = repaired_digests(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)).collect()[0]
    assert (row.gaps, row.cost, row.audit, row.repaired_sha256[:8]) == (0, 0, "", "e3b0c442")
    assert repaired_digests(spark.createDataFrame([], SCHEMA)).collect() == []
