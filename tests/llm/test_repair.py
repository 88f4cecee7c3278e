"""Operator 12 against a plain search over all edits, and its chunks against whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from larkspan.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
SF = "/root/testdata/sf0.001"


def plain_edits(steps):
    """(cost, edits) by relaxing all nodes again and again; edits are tried against the grammar as a pattern."""
    best = {(0, ""): (0, "")}  # rows consumed, and what the grammar needs of the role initials so far
    fits = lambda w: any(re.fullmatch("(s?(ua)+)?", w + x) for x in ("", "a", "ua"))
    state = lambda w: "" if not w else ("s" if w == "s" else ("u" if w[-1] == "u" else "ua"))
    changed = True
    while changed:
        changed = False
        for (i, w), (cost, audit) in list(best.items()):
            moves = [(i, w + x, 2, "I") for x in "ua"]
            if i < len(steps):
                initial, wrong = steps[i]
                moves.append((i + 1, w, 3, "D"))
                if wrong not in ("b", "d"):
                    more = wrong == "t"
                    moves += [(i + 1, w + x, 2 + more, "R") for x in "ua"]
                    if initial in ("s", "u", "a"):
                        moves.append((i + 1, w + initial, more, "K"))
            for j, v, c, e in moves:
                if fits(v):
                    node, new = (j, state(v)), (cost + c, audit + e)
                    if node not in best or new < best[node]:
                        best[node], changed = new, True
    return min(best[len(steps), w] for w in ("", "ua") if (len(steps), w) in best)


def plain(rows):
    """{conv_id: columns} of rows (conv_id, turn, role, text), with the damage, by plain loops."""
    by, out = defaultdict(list), {}
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = []
        for i, (_, role, text) in enumerate(own):
            chars = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("b" if not chars else "d" if any(r[1:] == (role, text) for r in own[:i]) else "t" if chars[-1] not in ".!?" else "")
        initials = [r[1][:1] for r in own]
        cost, audit = plain_edits(list(zip(initials, faults, strict=True)))
        left, at, said = [], 0, ""
        for e in audit:
            role, text = own[at][1:] if e in "KR" else ("", "")
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if said.endswith("u") else "user"
            said += role[0]
            left.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", said)
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def made(seed, n, most):
    rng = random.Random(seed)
    texts = ["", " \n", "yes.", "no", "why? ", "Well!\n", "a b c.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [(c if c % 7 else None, rng.choice([None, t, t + rng.randrange(3)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, most))]


def result(frame):
    got = frame.collect()
    out = {r[0]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def test_search_by_relaxing():
    rng = random.Random(1)
    for _ in range(300):
        steps = [(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(rng.randrange(7))]
        (got,) = repair.cheapest(steps).values()
        assert got == plain_edits(steps), steps


@pytest.mark.parametrize("limits", [(1024, 1 << 24, 512), (4, 1 << 24, 3), (0, 0, 1), (0, 0, 5)])
def test_repair_by_plain_loops(spark, limits):
    """Whole conversations, all in chunks, and some of each."""
    rows = made(2, 40, 9)
    got = result(repair.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), *limits))
    assert got == plain(rows)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    assert result(repair.query(spark, SF)) == want
    assert result(repair.repair(spark.read.parquet(f"{SF}/conversations.parquet"), 3, 1 << 24, 2)) == want


def test_long_conversations_in_chunks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(400)}{rng.choice(['.', ''])}") for t in range(1500)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    whole = result(repair.repair(frame, 1 << 20))
    assert result(repair.repair(frame, 100, 1 << 24, 64)) == whole and whole[1][5] > 0


def test_odd_rows_and_empty_tables(spark):
    none = hashlib.sha256().hexdigest()
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    big = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 > 4)
    rows = [(5, gone, "user", "x."), (6, kept, None, None), (8, big, "user", "word " * 1_000_000 + "end.")]
    for limits in ((1024, 1 << 24, 512), (0, 0, 2)):
        got = result(repair.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), *limits))
        assert got[5] == (0, 0, 0, 0, 0, 0, "", none)
        assert got[6] == (0, 1, 0, 0, 0, 3, "D", none)
        assert got[8] == (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(("user:" + rows[2][3] + "\nassistant:").encode()).hexdigest())
        assert repair.repair(spark.createDataFrame([], SCHEMA), *limits).collect() == []
