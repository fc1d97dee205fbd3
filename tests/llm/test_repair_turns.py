"""Repair of conversations, held against a search that keeps whole edit strings."""

import hashlib
import random
import re

import pytest

from textward.llm import repair_turns as rt

END = re.compile("(s?(ua)+)?").fullmatch


def _brute(rows):
    """(cost, letters, repaired) of the best of all edit sequences, rows as (role, text, fault), with up to two turns inserted before each row and at the end."""
    best = []

    def go(k, roles, cost, letters, out):
        if best and cost > best[0][0]:
            return
        inserts = [[]] + [[r] for r in "ua"] + [[a, b] for a in "ua" for b in "ua"]
        for more in inserts:
            now, total, word = roles + "".join(more), cost + 2 * len(more), letters + "I" * len(more)
            lines = out + [{"u": "user:", "a": "assistant:"}[r] for r in more]
            if not re.fullmatch("s?(ua)*u?", now):
                continue
            if k == len(rows):
                if END(now):
                    best.append((total, word, lines))
                    best.sort()
                    del best[1:]
                continue
            role, text, fault = rows[k]
            late = fault == "truncated"
            go(k + 1, now, total + 3, word + "D", lines)
            if fault not in ("blank", "duplicate"):
                go(k + 1, now + (role[:1] or "?"), total + late, word + "K", [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(k + 1, now + new[0], total + 2 + late, word + "R", [*lines, f"{new}:{text}"])

    go(0, "", 0, "", [])
    return best[0]


def _fault(rows, k):
    role, text = rows[k]
    if not text.strip(" \t\n\r\v\f"):
        return "blank"
    if rows[k] in rows[:k]:
        return "duplicate"
    return None if text.rstrip(" \t\n\r\v\f")[-1] in ".!?" else "truncated"


def _run(rows):
    found = rt.Conversation()
    settled = []
    for role, text, fault in rows:
        settled += found.add(role[:1], fault, (role, text))
    settled += found.close()
    lines = [f"{role or row[0]}:{row[1] if row else ''}" for letter, row, role in settled if letter != "D"]
    return "".join(x[0] for x in settled), lines, found


def test_repairs_equal_all_edit_sequences():
    draw = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5] * 40:
        rows = [(draw.choice(["system", "user", "assistant", "tool", "user", "assistant", ""]), draw.choice(["", "a", "b.", "c!", f"{k}.", " "])) for k in range(n)]
        rows = [(*r, _fault(rows, k)) for k, r in enumerate(rows)]
        cost, letters, lines = _brute(rows)
        assert _run(rows)[:2] == (letters, lines), rows


def _whole_strings(rows):
    """The same search with whole strings for each state."""
    states = {rt.NONE: (0, "")}
    for role, _, fault in rows:
        new = {}
        for state, (cost, word) in states.items():
            for _ in range(4):
                steps = [("D", state, 3)]
                if fault not in rt.MUST_GO:
                    steps.append(("R", rt.NEXT[state], 2 + (fault == "truncated")))
                    if (role[:1], state) in rt.KEPT:
                        steps.append(("K", rt.KEPT[role[:1], state], int(fault == "truncated")))
                for letter, to, more in steps:
                    new[to] = min(new.get(to, (9e9, "")), (cost + more, word + letter))
                state, cost, word = rt.NEXT[state], cost + 2, word + "I"
        states = new
    return min((c + 2 * rt.CLOSE[s], w + "I" * rt.CLOSE[s]) for s, (c, w) in states.items())[1]


@pytest.mark.parametrize("roles", [["user", "assistant"], ["system", "user", "assistant", "tool"], ["tool"], ["system"], ["user"], [""]])
@pytest.mark.parametrize("share", [0, 0.2, 1])
def test_long_conversations(roles, share):
    draw = random.Random(2)
    for n in (1, 2, 31, 32, 33, 64, 65, 700):
        rows = [(draw.choice(roles), str(k), draw.choice(["blank", "duplicate", "truncated"]) if draw.random() < share else None) for k in range(n)]
        assert _run(rows)[0] == _whole_strings(rows), (roles, share, n)


def test_memory_is_bounded():
    draw, row, found = random.Random(3), 0, rt.Conversation()
    for _ in range(60_000):
        row += 1
        role = draw.choice(["user", "assistant", "assistant", "system", "tool"])
        found.add(role[0], draw.choice([None, None, None, "blank", "truncated"]), row)
    assert found.most < 200
    found = rt.Conversation()
    for row in range(20_000):
        found.add("u", "blank", row)
    assert found.most < 200


def test_rows_of_any_shape(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 1, "assistant", "Yes"), (1, None, None, None), (None, None, "system", "s."), (None, 5, "user", "x"), (2, 7, "tool", " "), (3, 2, "assistant", "a."), (3, 9, "user", "b!\n")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, seq string").repartition(4)
    got = {r.conv_id: r for r in rt.digest(rt.edits(rt.faults(df))).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (0, 1, 1, 1, 2, 7, "DKKD")
    assert one.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes").hexdigest()
    assert (got[None].audit, got[None].illegal, got[None].gaps) == ("KKI", 0, 0)
    assert (got[2].audit, got[2].cost, got[2].repaired_sha256) == ("D", 3, hashlib.sha256(b"").hexdigest())
    assert got[3].gaps == 6 and got[3].audit == "IKKI"
    assert rt.repair_damaged(df.where("false")).count() == 0
    assert sorted(map(str, (r.conv_id for r in rt.repair_damaged(df).collect()))) == ["1", "2", "3", "None"]
    edits = rt.edits(rt.faults(df)).where("conv_id = 3").orderBy("seq").collect()
    assert [(e.edit, e.role, e.text, e.cost) for e in edits] == [("I", "user", "", 2), ("K", "assistant", "a.", 0), ("K", "user", "b!\n", 0), ("I", "assistant", "", 2)]


def test_conversations_that_settle_with_their_last_row_end(spark):
    sizes = {1: 32, 2: 3, 3: 64, 4: 96, 5: 33, 6: 31}
    rows = [(conv, k, ["user", "assistant"][k % 2], f"{k}.") for conv, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: r for r in rt.digest(rt.edits(rt.faults(df))).collect()}
    assert {conv: (r.audit, r.gaps, r.illegal) for conv, r in got.items()} == {conv: ("K" * n + "I" * (n % 2), 0, 0) for conv, n in sizes.items()}
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:32]).encode()).hexdigest()
    assert [e.ends for e in rt.edits(rt.faults(df)).where("conv_id = 3").orderBy("seq").collect()] == [False] * 63 + [True]
