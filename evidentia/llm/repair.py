"""Repair of conversations: the cheapest edits after which the roles read ``(system? (user assistant)+)?``.

Rows that are the same (conversation, turn, role, text) are counted before anything is shuffled, and later rows of one role
and text are told by the first turn that has them.  Ranges of (conversation, turn, role, text) are then read in order, in
slices of at most SLICE rows, so that a conversation of any length is spread over slices and tasks.

A slice of a conversation is solved by depth-first branch and bound with an explicit stack.  A node is a place in the rows
and the role that came last; its branches are the edits that may follow, least letter first.  Suffix lower bounds, worked
backwards over the slice with the ties of audits left out, tell what any completion costs at least; the incumbent is the
best (cost, audit) that reached the end; a table at each node keeps the best (cost, audit) of the prefixes that came to it and
drops worse ones.  The search ends when the stack is empty, and the incumbent is then proved optimal.  A conversation
inside a slice is done there and then.  Of one that touches the slice's edge the best (cost, audit) between all roles before
and after it go on; they are joined in order, and the hash of the repaired text is taken by reading its slices in order
(SHA-256 can't be computed in parts), with one slice in memory at a time.

Ties: of two cheapest edits with one cost the ASCII-least audit wins.  No audit of the same rows, end and cost is the
beginning of another (an insertion more costs more), so the best of a whole is made of the bests of its parts.

Defined results: a null role, text, turn or identifier counts as one space where text is made of it; a null identifier is a
conversation of its own; rows that repeat a turn are ordered by role, then text, bytewise; roles count by their first
character, whatever follows; a role without characters adds no initial, so its row may stay anywhere; a row that is
deleted keeps its role and text for telling later duplicates; a conversation without a row left has zeros, an empty audit
and the hash of the empty text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of a conversation that are searched at once.
SLICE = 512
#: What came last: nothing, or a role.  From each the roles that may follow, and where a conversation may end.
STATES = ("", "s", "u", "a")
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (0, 3)
NAMES = {2: "user", 3: "assistant"}
_INFINITE = 1 << 60
_BLANK = r"[^\x20\x09-\x0D]"
#: The last character that isn't white space.
_LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"

_TURN = [("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("fault", pa.string()), ("initial", pa.string())]
_COUNTS = ("gaps_low", "gaps_high", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal")
_SUMS = ("turns", "blank", "duplicate", "truncated", "illegal")
_WAY = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_FRAGMENT = pa.schema([("conv", pa.int64()), ("no_conv", pa.bool_()), ("part", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS],
                       ("first_initial", pa.string()), ("last_initial", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
                       ("ways", pa.list_(_WAY)), ("rows", pa.list_(pa.struct(_TURN)))])
_FRAGMENT_SPARK = ("conv long, no_conv boolean, part long, place long, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_initial string, last_initial string, cost long, "
                   "audit string, repaired_sha256 string, ways array<struct<enter:int,leave:int,cost:bigint,audit:string>>, rows array<struct<role:string,text:string,times:bigint,fault:string,initial:string>>")
_PIECE = pa.schema([("conv", pa.int64()), ("no_conv", pa.bool_()), ("part", pa.int64()), ("place", pa.int64()), ("enter", pa.int32()), ("piece", pa.string()), *[(c, pa.int64()) for c in
                    ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_PIECE_SPARK = "conv long, no_conv boolean, part long, place long, enter int, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, no_conv, turn, role, text, times): the rows after damage, equal rows counted.  The CRC-32 of ``conv_id:turn`` says
    what befalls a row."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    rows = rows.select(F.coalesce("conv", F.lit(0).cast("long")).alias("conv"), F.col("conv").isNull().alias("no_conv"), "turn", role.alias("role"), text.alias("text"),
                       F.when(F.col("what") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv", "no_conv", "turn", "role", "text").agg(F.sum("n").cast("long").alias("times"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Each row (of ``damaged``) with the first fault of its first copy, ``blank``, ``duplicate``, ``truncated`` or none, and its role's initial."""
    rows = rows.withColumn("at", F.struct(F.col("turn").isNotNull().alias("said"), "turn"))
    hashed = rows.withColumn("of", F.sha2("text", 256))
    firsts = hashed.groupBy("conv", "no_conv", "role", "of").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = hashed.join(firsts, ["conv", "no_conv", "role", "of"], "left")
    last = F.regexp_extract("text", _LAST, 1)
    fault = (F.when(~F.col("text").rlike(_BLANK), "blank").when(F.col("first").isNotNull() & (F.col("at") > F.col("first")), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    return rows.select("conv", "no_conv", "turn", "role", "text", "times", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def kept_in(state: int, initial: str) -> list[int]:
    """Where keeping a row with this initial leads, if it may be kept."""
    return [to for to in FOLLOWS[state] if STATES[to] == initial] if initial else [state]


def _edits(row: dict, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row's first copy as (letter, cost, state after), least letter first.  Its other copies, duplicates or
    blank like itself, are deleted after it."""
    out = [("D", DELETE, state)]
    if row["fault"] in ("", "truncated"):
        extra = TRUNCATED if row["fault"] else 0
        out += [("K", extra, to) for to in kept_in(state, row["initial"])]
        out += [("R", REROLE + extra, to) for to in FOLLOWS[state] if to in NAMES]
    return out


def lower_bounds(rows: list[dict], ends: tuple[int, ...]) -> list[list[int]]:
    """By place and state, what reaching one of the ends costs at least."""
    bounds = [[_INFINITE] * 4 for _ in range(len(rows) + 1)]
    for at in range(len(rows), -1, -1):
        now = bounds[at]
        for state in range(4):
            if at == len(rows):
                now[state] = 0 if state in ends else _INFINITE
            else:
                now[state] = min(cost + bounds[at + 1][to] for _, cost, to in _edits(rows[at], state)) + DELETE * (rows[at]["times"] - 1)
        for _ in range(3):  # insertions lead from state to state
            for state in range(4):
                now[state] = min([now[state], *(INSERT + now[to] for to in FOLLOWS[state] if to in NAMES)])
    return bounds


def search(rows: list[dict], enter: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The least (cost, audit) from a state to one of the ends over the rows; None if no edits lead there."""
    bounds = lower_bounds(rows, ends)
    best: tuple[int, str] | None = None
    reached: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(len(rows) + 1)]
    stack = [(0, enter, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if bounds[at][state] >= _INFINITE or best is not None and (cost + bounds[at][state], audit) >= (best[0], best[1]):
            continue
        before = reached[at][state]
        if before is not None and before <= (cost, audit):
            continue
        reached[at][state] = (cost, audit)
        if at == len(rows) and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        branches = []
        if at < len(rows):
            more = rows[at]["times"] - 1
            branches = [(at + 1, to, cost + price + DELETE * more, audit + letter + "D" * more) for letter, price, to in _edits(rows[at], state)]
        branches += [(at, to, cost + INSERT, audit + "I") for to in FOLLOWS[state] if to in NAMES]
        stack.extend(sorted((b for b in branches if bounds[b[0]][b[1]] < _INFINITE), key=lambda b: (b[2] + bounds[b[0]][b[1]], b[3]), reverse=True))
    return best


def render(rows: list[dict], audit: str, state: int = 0) -> list[str]:
    """The lines ``role:text`` that the edits make of the rows, entered in a state."""
    out, left, copies = [], iter(rows), 0
    row: dict = {}
    for letter in audit:
        if letter == "I":
            state = next(to for to in FOLLOWS[state] if to in NAMES)
            out.append(NAMES[state] + ":")
            continue
        if not copies:
            row = next(left)
            copies = row["times"]
        copies -= 1
        if letter == "K":
            state = kept_in(state, row["initial"])[0]
            out.append(f"{row['role']}:{row['text']}")
        elif letter == "R":
            state = next(to for to in FOLLOWS[state] if to in NAMES)
            out.append(f"{NAMES[state]}:{row['text']}")
    return out


def _bad(a: str, b: str) -> int:
    return int(a + b not in ("su", "ua", "au") or not a or not b)


def _counts(rows: list[dict]) -> dict:
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    n = {"gaps_low": turns[0] if turns else None, "gaps_high": turns[-1] if turns else None, "turns": len(set(turns)), "first_turn": rows[0]["turn"], "last_turn": rows[-1]["turn"]}
    n |= {f: sum(1 for r in rows if r["fault"] == f) for f in ("blank", "duplicate", "truncated")}
    n["blank"] += sum(r["times"] - 1 for r in rows if r["fault"] == "blank")
    n["duplicate"] += sum(r["times"] - 1 for r in rows if r["fault"] != "blank")
    n["illegal"] = sum(_bad(a["initial"], b["initial"]) for a, b in zip(rows, rows[1:])) + sum((r["times"] - 1) * _bad(r["initial"], r["initial"]) for r in rows)
    return n | {"first_initial": rows[0]["initial"], "last_initial": rows[-1]["initial"]}


def _fragment(rows: list[dict], part: int, place: int, whole: bool) -> dict:
    out = {"conv": rows[0]["conv"], "no_conv": rows[0]["no_conv"], "part": part, "place": place, "whole": whole} | _counts(rows)
    if whole:
        out["cost"], out["audit"] = search(rows)
        out["repaired_sha256"] = hashlib.sha256("\n".join(render(rows, out["audit"])).encode("utf-8", "surrogatepass")).hexdigest()
        return out | {"ways": None, "rows": None}
    found = [(a, b, search(rows, a, (b,))) for a in range(4) for b in range(4)]
    ways = [{"enter": a, "leave": b, "cost": best[0], "audit": best[1]} for a, b, best in found if best is not None]
    return out | {"cost": None, "audit": None, "repaired_sha256": None, "ways": ways, "rows": [{k: r[k] for k, _ in _TURN} for r in rows]}


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found in the sorted rows of a partition.  A conversation that may go on before or after the rows at hand is
    not whole: the first and the last of the partition, and what is cut at SLICE rows."""
    held: list[dict] = []
    part, place, opened = 0, 0, True  # opened: the rows held may have others of their conversation before them
    out: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            part = row["part"]
            if held and (held[-1]["conv"], held[-1]["no_conv"]) != (row["conv"], row["no_conv"]):
                out.append(_fragment(held, part, place, not opened))
                held, place, opened = [], place + 1, False
            elif len(held) == SLICE:
                out.append(_fragment(held, part, place, False))
                held, place, opened = [], place + 1, True
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENT)
            out = []
    if held:
        yield pa.RecordBatch.from_pylist([_fragment(held, part, place, False)], schema=_FRAGMENT)


def _conv(row: dict) -> tuple:
    return row["conv"], row["no_conv"]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the sorted fragments of conversations, the edits of each fragment; the counts and the whole audit stand in the first."""
    for (conv, none), fragments in groupby(_rows_of(batches), _conv):
        best: dict[int, tuple[int, str]] = {0: (0, "")}
        came: list[tuple[int, int, dict[int, tuple[int, int]]]] = []  # by state after a fragment: the state before it, and the length of the audit
        total = dict.fromkeys(_SUMS, 0)
        low = high = None
        last: dict | None = None
        for f in fragments:
            after: dict[int, tuple[int, str]] = {}
            back: dict[int, tuple[int, int]] = {}
            for w in f["ways"]:
                if w["enter"] in best:
                    cost, audit = best[w["enter"]]
                    new = (cost + w["cost"], audit + w["audit"])
                    if w["leave"] not in after or new < after[w["leave"]]:
                        after[w["leave"]], back[w["leave"]] = new, (w["enter"], len(audit))
            best = after
            came.append((f["part"], f["place"], back))
            for k in _SUMS:
                total[k] += f[k]
            if last is not None:
                total["turns"] -= int(f["first_turn"] is not None and last["last_turn"] == f["first_turn"])
                total["illegal"] += _bad(last["last_initial"], f["first_initial"])
            low = f["gaps_low"] if low is None else low
            high = f["gaps_high"] if f["gaps_high"] is not None else high
            last = {k: f[k] for k in ("last_turn", "last_initial")}
        cost, audit, state = min((*best[s], s) for s in ENDS if s in best)
        pieces, end = [], len(audit)
        for part, place, back in reversed(came):
            enter, start = back[state]
            pieces.append((part, place, enter, audit[start:end]))
            state, end = enter, start
        gaps = 0 if low is None else high - low + 1 - total["turns"]
        rows = [{"conv": conv, "no_conv": none, "part": p, "place": at, "enter": enter, "piece": piece} for p, at, enter, piece in reversed(pieces)]
        rows[0] |= {"gaps": gaps, "cost": cost, "audit": audit} | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist(rows[at : at + 1024], schema=_PIECE)


_HASHED = pa.schema([("conv", pa.int64()), ("no_conv", pa.bool_()), ("repaired_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, read fragment by fragment."""
    for (conv, none), fragments in groupby(_rows_of(batches), _conv):
        known, first = hashlib.sha256(), True
        for f in fragments:
            for line in render(f["rows"], f["piece"], f["enter"]):
                known.update(("" if first else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                first = False
        yield pa.RecordBatch.from_pylist([{"conv": conv, "no_conv": none, "repaired_sha256": known.hexdigest()}], schema=_HASHED)


def solve(rows: DataFrame) -> DataFrame:
    """From ``with_faults`` (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each
    conversation that has rows."""
    short_batches()
    order: list[Column] = [F.col("conv"), F.col("no_conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    # equal beginnings of texts stand together, so that a range is told by a bounded key
    placed = rows.repartitionByRange(*order, F.substring("text", 1, 200)).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id().cast("long"))
    found = cut(placed.mapInArrow(_fragments, _FRAGMENT_SPARK))
    key, place = ["conv", "no_conv"], ["conv", "no_conv", "part", "place"]
    parts = found.where("not whole")
    pieces = cut(parts.drop("rows").repartition(*key).sortWithinPartitions(*place).mapInArrow(_joined, _PIECE_SPARK))
    texts = parts.select(*place, "rows").join(pieces.select(*place, "enter", "piece"), place)
    hashes = texts.repartition(*key).sortWithinPartitions(*place).mapInArrow(_hashed, "conv long, no_conv boolean, repaired_sha256 string")
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    apart = pieces.where("cost is not null").join(hashes, key).select(*key, "gaps", *numbers)
    gaps = F.coalesce(F.col("gaps_high") - F.col("gaps_low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    every = found.where("whole").select(*key, gaps.alias("gaps"), *numbers).unionByName(apart)
    return every.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "gaps", *numbers)


def repair(conversations: DataFrame) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    solved = solve(with_faults(damaged(conversations))).withColumnRenamed("conv_id", "its")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(solved, F.col("conv_id").eqNullSafe(F.col("its")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
