"""Operator 12: repair of conversation structure by the cheapest edits.

A conversation's rows and the states of the grammar `(s?(ua)+)?` span a lattice: node (rows consumed, state).
Keep, rerole and delete consume a row, insert doesn't. Dijkstra's search runs on it without building it; the
priority is (cost, edits so far), so the first accepting end node that is popped carries the cheapest edits,
the least in ASCII among equals.

Conversations beyond ROWS rows or BYTES of text aren't brought into one place: their rows are sorted by range,
cut into chunks, each searched from every state to every state, and the chunks' results are put together in
order. Of edits between the same states over the same rows with equal cost none begins another, so the least
of a whole is made of the least of its chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import BLANKS, table, written

#: A conversation with more rows or bytes of text than these is searched in chunks of CHUNK rows at most.
ROWS, BYTES, CHUNK = 1024, 1 << 24, 512
#: A conversation with this share of all rows or more is told apart by broadcast; there are at most as many as its inverse.
OFTEN = 1 / 4096
DELETE, INSERT, KEEP, REROLE = "DIKR"
#: States of the grammar: nothing yet, after s, after u, after a; the role initials that each takes, and where to.
TAKES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def fault(text: str, seen: bool) -> str:
    """blank, duplicate, truncated or nothing, by the first letter."""
    bare = text.strip(BLANKS)
    if not bare:
        return "b"
    if seen:
        return "d"
    return "" if bare[-1] in ".!?" else "t"


def _wanted(state: int) -> str:
    """The one role that may be inserted or set in a state."""
    return "a" if state == 2 else "u"


def cheapest(steps: list[tuple[str, str]], start: int = 0, ends: tuple[int, ...] = ENDS, first: bool = True) -> dict[int, tuple[int, str]]:
    """{state: (cost, edits)} of the end nodes reached from `start` over steps (role initial, fault): the first
    one popped only, or each of `ends` that can be reached."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(steps) and state in ends:
            found[state] = (cost, audit)
            if first or len(found) == len(ends):
                break
        want = _wanted(state)
        heappush(heap, (cost + 2, audit + INSERT, i, TAKES[state][want]))
        if i == len(steps):
            continue
        initial, wrong = steps[i]
        heappush(heap, (cost + 3, audit + DELETE, i + 1, state))
        if wrong in ("b", "d"):
            continue
        more = cost + (wrong == "t")
        if initial in TAKES[state]:
            heappush(heap, (more, audit + KEEP, i + 1, TAKES[state][initial]))
        heappush(heap, (more + 2, audit + REROLE, i + 1, TAKES[state][want]))
    return found


def applied(rows: list[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[str], int]:
    """(the lines role:text that edits leave of rows (role, text), the state they end in)."""
    lines, at = [], 0
    for edit in audit:
        if edit == DELETE:
            at += 1
            continue
        role, text = rows[at] if edit != INSERT else ("", "")
        initial = role[:1] if edit == KEEP else _wanted(state)
        lines.append(f"{role if edit == KEEP else NAMES[initial]}:{text}")
        state = TAKES[state][initial]
        at += edit != INSERT
    return lines, state


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repaired(rows: list[tuple]) -> tuple:
    """What a conversation's rows (turn, role, text), in order, come to: the values of COLUMNS."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    (cost, audit), = cheapest(list(zip(initials, faults, strict=True))).values()
    lines, _ = applied([r[1:] for r in rows], audit)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal(initials), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone): conv is conv_id as text, null as a space. By crc32 of `conv_id:turn`
    modulo 20 a row goes (it stays as a mark, so that its conversation does), loses its text or its marks
    of a sentence's end, comes twice, or becomes the user's."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(told("conv_id").alias("conv"), F.col("turn").cast("long"), told("role").alias("role"), told("text").alias("text"), F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))).alias("_h"))
    kind = F.col("_h") % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))).alias("_c"))
    return rows.drop("_c")


def short_repairs(rows: DataFrame) -> DataFrame:
    """(conv, COLUMNS): whole conversations, one after the other in a task, each sorted by turn, role and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, conv, out = [], None, []
        for b in batches:
            turns = [None if pd.isna(t) else int(t) for t in b["turn"]]
            for c, turn, role, text, gone in zip(b["conv"], turns, b["role"], b["text"], b["gone"], strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, *repaired(held)))
                    held, conv = [], c
                if not gone:
                    held.append((turn, role, text))
            yield pd.DataFrame(out, columns=names)
            out = []
        if conv is not None:
            yield pd.DataFrame([(conv, *repaired(held))], columns=names)

    names = ["conv", *(c.split()[0] for c in COLUMNS.split(", "))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInPandas(run, f"conv string, {COLUMNS}")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """(conv, its rows) of rows sorted by conv, without holding a conversation."""
    from itertools import groupby

    rows = (r for b in batches for r in b.itertuples(index=False, name=None))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, own


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk the cheapest edits from state to state, its outer initials, and its counts."""
    for b in batches:
        out = []
        for conv, chunk, rows in zip(b["conv"], b["chunk"], b["rows"], strict=True):
            steps = [(r["initial"], r["fault"]) for r in rows]
            ways = [(s, e, c, a) for s in range(4) for e, (c, a) in cheapest(steps, s, (0, 1, 2, 3), first=False).items()]
            initials, wrong = [s[0] for s in steps], [s[1] for s in steps]
            out.append((conv, chunk, ways, initials[0], initials[-1], illegal(initials), *(wrong.count(k) for k in "bdt")))
        yield pd.DataFrame(out, columns=["conv", "chunk", "ways", "head", "tail", "illegal", "blank", "duplicate", "truncated"])


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation: chunks' results put together in order, with the edits of each chunk."""
    for conv, chunks in _runs(batches):
        best, bad, tail, counts, order = {0: (0, "", ())}, 0, None, [0, 0, 0], []
        for _, chunk, ways, head, last, inside, *wrong in chunks:
            now = {}
            for w in ways:
                if w["s"] in best:
                    cost, audit, parts = best[w["s"]]
                    new = (cost + w["c"], audit + w["a"], (parts, w["a"], w["s"]))
                    if w["e"] not in now or new[:2] < now[w["e"]][:2]:
                        now[w["e"]] = new
            bad += inside + (tail is not None and tail + head not in LEGAL)
            best, tail, counts = now, last, [x + y for x, y in zip(counts, wrong, strict=True)]
            order.append(chunk)
        cost, audit, parts = min(best[e] for e in ENDS if e in best)
        slices = []
        while parts:
            parts, own, state = parts
            slices.append((own, state))
        slices = [(chunk, own, state) for chunk, (own, state) in zip(order, reversed(slices), strict=True)]
        yield pd.DataFrame({"conv": [conv], "blank": counts[:1], "duplicate": counts[1:2], "truncated": counts[2:], "illegal": [bad], "cost": [cost], "audit": [audit], "slices": [slices]})


def _told(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    lines, _ = applied(list(zip(pdf["role"], pdf["text"], strict=True)), pdf["own"].iloc[0], int(pdf["state"].iloc[0]))
    return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "n": [len(lines)], "lines": ["\n".join(lines)]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for conv, parts in _runs(batches):
        h, begun = hashlib.sha256(), False
        for _, _, n, lines in parts:
            if n:
                h.update((b"\n" if begun else b"") + lines.encode())
                begun = True
        yield pd.DataFrame({"conv": [conv], "repaired_sha256": [h.hexdigest()]})


def long_repairs(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, COLUMNS) as short_repairs(), with a conversation's rows dealt over tasks by range and searched in
    chunks. Only the chunks' edits, and then their lines, pass a task in order, a chunk at a time; the hash
    and the edits of a conversation are single values, so that much can't be parted."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ("conv", "turn", "role", "text")
    sorted_ = rows.where("NOT gone").repartitionByRange(n, *key).sortWithinPartitions(*key).drop("gone")
    kept = written(sorted_.withColumn("seq", F.monotonically_increasing_id()), "repair-rows")
    kept = kept.withColumn("chunk", F.floor(F.col("seq") / chunk))
    once = kept.groupBy("conv", "role", F.md5("text").alias("_t"), F.length("text").alias("_l")).agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_new"))
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    steps = kept.select("conv", "chunk", "seq", F.substring("role", 1, 1).alias("initial"), bare.substr(-1, 1).alias("_end"), (bare == "").alias("_blank"))
    wrong = F.when(F.col("_blank"), "b").when(F.col("_new").isNull(), "d").when(~F.col("_end").isin(".", "!", "?"), "t").otherwise("")
    steps = steps.join(once, "seq", "left").withColumn("fault", wrong)
    grouped = steps.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "initial", "fault"))).alias("rows"))  # at most `chunk` rows
    ways = grouped.mapInPandas(_searched, "conv string, chunk long, ways array<struct<s:int,e:int,c:long,a:string>>, head string, tail string, illegal long, blank long, duplicate long, truncated long")
    dealt = ways.repartition(n, "conv").sortWithinPartitions("conv", "chunk")
    found = written(dealt.mapInPandas(_composed, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, slices array<struct<chunk:long,own:string,state:int>>"), "repair-edits")
    slices = found.select("conv", F.explode("slices").alias("x")).select("conv", "x.*")
    told = kept.join(slices, ["conv", "chunk"]).groupBy("conv", "chunk").applyInPandas(_told, "conv string, chunk long, n long, lines string")
    hashes = told.repartition(n, "conv").sortWithinPartitions("conv", "chunk").mapInPandas(_hashed, "conv string, repaired_sha256 string")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    turns = kept.groupBy("conv").agg(F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"))
    out = rows.select("conv").distinct().join(found.drop("slices"), "conv", "left").join(hashes, "conv", "left").join(turns, "conv", "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return out.na.fill(none).select("conv", *(c.split()[0] for c in COLUMNS.split(", ")))


def repair(conversations: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id of conversations (conv_id, turn, role, text) after damaged(): conv_id and COLUMNS.

    Rows stand in the order of turn, nulls first, then role and text. Null roles and texts are a space, and
    null conversations are one of their own; a role without letters fits nowhere and is set or deleted.
    Repeated rows are duplicates; other columns are left out, whatever their names; an empty table gives no
    rows. What a task holds is bounded by the limits on rows and bytes, but for a single very long text.
    """
    rows = damaged(conversations)
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("_b"))
    sizes = written(sizes.where((F.col("n") > most_rows) | (F.col("_b") > most_bytes)).select("conv", "n"), "repair-long")
    short = rows
    out = None
    if not sizes.isEmpty():
        total = rows.count()
        often, rest = sizes.where(F.col("n") >= OFTEN * total).select("conv"), sizes.where(F.col("n") < OFTEN * total).select("conv")
        short = rows.join(F.broadcast(often), "conv", "left_anti").join(rest, "conv", "left_anti")
        out = long_repairs(rows.join(F.broadcast(often), "conv", "left_semi").unionByName(rows.join(rest, "conv", "left_semi")), chunk)
    out = short_repairs(short) if out is None else short_repairs(short).unionByName(out)
    return out.select(F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id"), *(c.split()[0] for c in COLUMNS.split(", ")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
