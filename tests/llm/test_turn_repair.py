"""Repair of conversations against a plain programme over strings."""

import functools
import random
import re
import zlib

import brute
import numpy as np
import pytest

from windfold.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, copies string"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def best(faults, initials):
    """Cheapest edits of one conversation: cost and least letters."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def least(i, state, added):
        found = []
        if i == len(faults):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            found.append((4, "D") + (least(i + 1, state, 0),))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if (state, initials[i]) in move:
                    found.append((extra, "K", least(i + 1, move[state, initials[i]], 0)))
                for to in "ua":
                    if (state, to) in move:
                        found.append((3 + extra, "R", least(i + 1, move[state, to], 0)))
        if added < 2:
            for to in "ua":
                if (state, to) in move:
                    found.append((3, "I", least(i, move[state, to], added + 1)))
        found = [f if len(f) == 2 else (f[0] + f[2][0], f[1] + f[2][1]) for f in found]
        return min(found, default=(10**9, ""))

    out = least(0, "", 0)
    least.cache_clear()
    return out


def repaired(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit = best(faults, initials)
        i, lines, last = 0, [], None
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            role = {None: "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if letter == "K":
                role = mine[i][2]
            lines.append(f"{role}:{'' if letter == 'I' else mine[i][3]}")
            i, last = i + (letter != "I"), role[0]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, brute.sha("\n".join(lines)))
    return out


def odd_rows():
    r, rows = random.Random(11), []
    texts = ["Yes.", "No!", "why", "", " \t", "A long one? ", "cut\n", None, "Ünï.", "x" * 3000, " ", "end.\x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "Sage"]
    for conv in range(160):
        for turn in range(r.randrange(1, 14)):
            rows.append((conv, r.choice([turn, turn, turn, None, turn // 2, -turn]), r.choice(roles), r.choice(texts)))
    rows += [(None, k, r.choice(roles), r.choice(texts)) for k in range(30)]
    rows += [(500, 3, "user", "Same.")] * 40 + [(501, None, None, None)] * 5
    # one conversation with a third of all rows, in long runs and without any order
    rows += [(700, k, ["user", "tool", "assistant", "system"][k // 97 % 4], f"Row {k % 211}{'.' if k % 5 else ''}") for k in range(600)]
    rows += [(700, 600 + k, r.choice(roles), r.choice(texts)) for k in range(200)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 5, "clash") for x in rows], SCHEMA).repartition(5)


def result(rows):
    return {r.conv_id: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("partition_bytes", [1 << 25, 6000])
def test_repair(spark, partition_bytes):
    rows = odd_rows()
    want = repaired([(a, b, *(" " if x is None else x for x in t)) for a, b, *t in rows])
    out = turn_repair.repair(frame(spark, rows), partition_bytes).collect()
    assert result(out) == want and len(out) == len(want)
    turns = {}
    for r in sorted(turn_repair.repaired_turns(frame(spark, rows), partition_bytes).collect(), key=lambda r: (r.part, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(brute.sha("\n".join(turns.get(k, []))) == v[-1] for k, v in want.items())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in turns.values())


@pytest.mark.parametrize("partition_bytes", [1 << 25, 9000])
def test_damage_and_repair(spark, partition_bytes):
    rows = odd_rows() + [(900, t, "user", "Gone.") for t in range(400) if zlib.crc32(f"900:{t}".encode()) % 20 == 0]
    hurt = damage(rows)
    assert sorted(map(repr, map(tuple, turn_repair.damaged(frame(spark, rows)).collect()))) == sorted(map(repr, hurt))
    want = {k: (0, 0, 0, 0, 0, 0, "", brute.sha("")) for k in {r[0] for r in rows}} | repaired(hurt)
    out = turn_repair.damage_and_repair(frame(spark, rows), partition_bytes).collect()
    assert result(out) == want and len(out) == len(want) and want[900][-2] == ""


def test_long_runs_and_wide_turns(spark):
    rows = [(1, k, "user", f"Say {k}.") for k in range(3000)] + [(2, 0, "user", "Once.")] * 50_000
    rows += [(3, -(2**63), "user", "y" * 3_000_000), (3, 2**63 - 1, "assistant", " " * 2_000_000 + "!")]
    want = repaired(rows[:60] + rows[-2:])
    out = result(turn_repair.repair(frame(spark, rows), 40_000).collect())
    assert out[3] == (None, *want[3][1:])
    # every second one becomes the assistant's
    assert out[1][5] == 3 * 1500 and out[1][6] == "KR" * 1500
    assert out[2][2] == 49_999 and out[2][5] == 49_999 * 4 + 3 and sorted(out[2][6]) == ["D"] * 49_999 + ["I", "K"]
    assert result(turn_repair.repair(frame(spark, rows[:60]), 40_000).collect()) == {1: want[1]}


def test_powers_are_products():
    for symbol in range(9):
        after, one = turn_repair.END, turn_repair.END
        costs = turn_repair.along(symbol, 37, after)
        for n in range(38):
            assert (costs[n] == one).all() and (turn_repair.before(symbol, n, after) == one).all()
            assert (turn_repair.matrix([(symbol, n)] if n else []) + after).min(1).tolist() == one.tolist()
            one = (turn_repair.power(symbol, 0) + one).min(1)
    assert np.diag(turn_repair.INSERTS).tolist() == [0] * 4


def test_empty(spark):
    assert turn_repair.repair(frame(spark, [])).collect() == [] == turn_repair.damage_and_repair(frame(spark, [])).collect()
    assert turn_repair.repaired_turns(frame(spark, [])).collect() == []


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", brute.sha("")) for r in rows} | repaired(damage(rows))
    assert result(queries.queries()["op11_turn_repair"](spark, "/root/testdata/sf0.01").collect()) == want
