"""Conversations brought into shape by the cheapest edits, with square-root checkpoints.

A conversation in shape is empty, or has an optional system row and then pairs of
a user and an assistant row. Rows are kept, given the role that fits, deleted, or
put in with an empty text. Costs run backward: for each row and each of four
states (nothing yet, after the system row, after a user, after an assistant) the
cost of the cheapest way to the end. Walking forward, the ASCII-least letter that
is still on a cheapest way is taken. Only every √n-th vector of costs is stored;
those between are computed again when the walk comes there.

Rows are dealt by range of (conversation, turn, role, hash of the text), so that a
conversation with a third of all rows is spread over tasks. A conversation that
lies within one task and ``BLOCK`` rows and bytes is finished there. Any other is
cut into blocks, and the block ends are the checkpoints: a block is summarised by
the cost from each state to each, those are scanned backward per conversation
(one small row per block), each block then maps four entry states to exit states,
these are scanned forward, and the blocks walk from their entry states.

Order within a conversation: turn (nulls first), then role and a hash of the text.
Defined results: a null role or text is one space; a null ``conv_id`` is a
conversation; equal rows are duplicates; an empty table gives no rows; extra
columns are ignored; ``gaps`` beyond a long are the greatest long.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkdesk.llm.common import join_alike, stage

BLOCK = 4096
BLOCK_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = [USER, USER, ASSISTANT, USER]  # the state after a row that is put in or given a role
KEPT = [{0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER}]  # by state, then by role class
AT_END = (0, 4, 2, 0)
FAR = 1 << 50
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

_LONG = (1 << 63) - 1
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_STAGED = (
    "whole boolean, conv_id long, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired string, first_turn long, last_turn long, turns long, codes binary, "
    "idents array<binary>, roles array<string>, texts array<string>"
)
_NAMES = [f.split()[0] for f in _STAGED.split(", ")]

Vector = tuple[int, ...]


@functools.cache
def _back(code: int, after: Vector) -> tuple[int, Vector]:
    """The vector before a row, from the one after it, as its least cost and what is beyond that."""
    role, fault = code & 3, code >> 2
    cost = [3 + c for c in after]
    if fault not in (BLANK, DUPLICATE):
        extra = int(fault == TRUNCATED)
        for s in range(4):
            cost[s] = min(cost[s], 2 + extra + after[FOLLOWING[s]])
            if role in KEPT[s]:
                cost[s] = min(cost[s], extra + after[KEPT[s][role]])
    user, assistant = min(cost[USER], 2 + cost[ASSISTANT]), min(cost[ASSISTANT], 2 + cost[USER])
    closed = (min(cost[START], 2 + user), min(cost[SYSTEM], 2 + user), user, assistant)
    least = min(closed)
    return least, tuple(min(c - least, FAR) for c in closed)


def vectors(codes: bytes, end: Vector, begin: int, stop: int, every: int = 1) -> dict[int, Vector]:
    """Vectors before the rows ``begin`` to ``stop``, from the one at ``stop``: those at multiples of ``every``."""
    base = min(end)
    now = tuple(c - base for c in end)
    out = {}
    for i in range(stop - 1, begin - 1, -1):
        more, now = _back(codes[i], now)
        base += more
        if i % every == 0:
            out[i] = tuple(base + c for c in now)
    return out


def walk(codes: bytes, end: Vector, state: int, last: bool) -> tuple[list[str], int, int]:
    """The edits of each row (those put in before it, then its own), the state after, and the cost from ``state``.

    ``end`` is the vector after the last row; with ``last`` the walk goes on to the end of the conversation.
    """
    n = len(codes)
    every = max(1, math.isqrt(n))
    checkpoints = vectors(codes, end, 0, n, every) | {n: end}
    cost = checkpoints[0][state]
    edits = []
    for begin in range(0, n, every):
        stop = min(begin + every, n)
        inside = vectors(codes, checkpoints[stop], begin, stop) | {stop: checkpoints[stop]}
        for i in range(begin, stop):
            now, after = inside[i], inside[i + 1]
            role, fault = codes[i] & 3, codes[i] >> 2
            letters = ""
            while True:
                if now[state] == 3 + after[state]:
                    letters += "D"
                elif now[state] == 2 + now[FOLLOWING[state]]:
                    letters += "I"
                    state = FOLLOWING[state]
                    continue
                elif role in KEPT[state] and now[state] == (fault == TRUNCATED) + after[KEPT[state][role]]:
                    letters += "K"
                    state = KEPT[state][role]
                else:
                    letters += "R"
                    state = FOLLOWING[state]
                break
            edits.append(letters)
    if last:
        edits.append("I" * (AT_END[state] // 2))
        state = START if state == START else ASSISTANT
    return edits, state, cost


def repaired_lines(edits: list[str], roles: list[str], texts: list[str], state: int) -> str:
    """The rows that the edits leave, as ``role:text`` lines."""
    lines = []
    names = {USER: "user", ASSISTANT: "assistant"}
    for i, letters in enumerate(edits):
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                state = KEPT[state][role_class(roles[i])]
                lines.append(f"{roles[i]}:{texts[i]}")
            else:
                state = FOLLOWING[state]
                lines.append(f"{names[state]}:{texts[i] if letter == 'R' else ''}")
    return "\n".join(lines)


def role_class(role: str) -> int:
    return INITIALS.get(role[:1], 3)


def ident(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def codes_of(roles: list[str], texts: list[str], idents: list[bytes], seen: set[bytes]) -> bytes:
    """A row's role class and first fault in one byte each; ``seen`` holds what came before and is added to."""
    out = bytearray()
    for role, text, own in zip(roles, texts, idents):
        body = text.rstrip(WHITE)
        fault = BLANK if not body else DUPLICATE if own in seen else 0 if body[-1] in ".!?" else TRUNCATED
        seen.add(own)
        out.append(role_class(role) + 4 * fault)
    return bytes(out)


def illegal_pairs(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


def fault_counts(codes: bytes) -> dict[str, int]:
    faults = [c >> 2 for c in codes]
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}


def _block(conv: int | None, seq: int, rows: list[tuple], whole: bool) -> dict:
    turns = [t for t, _, _ in rows if t is not None]
    roles, texts = [r for _, r, _ in rows], [x for _, _, x in rows]
    idents = [ident(r, x) for r, x in zip(roles, texts)]
    distinct = len(set(turns))
    out = dict.fromkeys(_NAMES) | {"whole": whole, "conv_id": conv, "seq": seq}
    codes = codes_of(roles, texts, idents, set())
    if not whole:
        span = {"first_turn": turns[0], "last_turn": turns[-1]} if turns else {}
        return out | span | {"turns": distinct, "codes": codes, "idents": idents, "roles": roles, "texts": texts}
    edits, _, cost = walk(codes, AT_END, START, True)
    return out | fault_counts(codes) | {
        "gaps": min(turns[-1] - turns[0] + 1 - distinct, _LONG) if turns else 0, "illegal": illegal_pairs(codes),
        "cost": cost, "audit": "".join(edits), "repaired": repaired_lines(edits, roles, texts, START),
    }


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """Whole conversations with their results, and blocks of those that go beyond a task or a block."""
    schema = to_arrow_schema(StructType.fromDDL(_STAGED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = TaskContext.get().partitionId() << 40, 0
        conv, own, size, cut = None, [], 0, True  # a task's first conversation may have begun in another
        ready: list[dict] = []
        held = 0
        for b in batches:
            for c, turn, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text"))):
                other = bool(own) and c != conv
                if other or len(own) >= block or size >= BLOCK_BYTES:
                    ready.append(_block(conv, at + seq, own, other and not cut))
                    held += size
                    seq, own, size, cut = seq + 1, [], 0, not other
                conv = c
                own.append((turn, role, text))
                size += len(text)
                if held >= BLOCK_BYTES or len(ready) >= 4096:
                    yield pa.RecordBatch.from_pylist(ready, schema=schema)
                    ready, held = [], 0
        if own:  # and its last may go on in the next
            ready.append(_block(conv, at + seq, own, False))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    # equal rows differ by a number of their own, or a range could not part them
    keyed = given.withColumns({"own": F.monotonically_increasing_id(), "hash": F.xxhash64("text")})
    order = ["conv_id", "turn", "role", "hash", "own"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text").mapInArrow(run, _STAGED)


def _across(cut: DataFrame) -> DataFrame:
    """Blocks (conv_id, seq, codes and turns) with duplicates of rows in earlier blocks marked."""
    held = cut.select("conv_id", "seq", F.explode(F.array_distinct("idents")).alias("ident"))
    first = Window.partitionBy("conv_id", "ident")  # a row per block that holds the ident
    again = held.withColumn("first", F.min("seq").over(first)).where("seq > first")
    marks = again.groupBy("seq").agg(F.collect_list("ident").alias("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for codes, idents, seen in zip(*(b.column(n).to_pylist() for n in ("codes", "idents", "seen"))):
                known = set(seen or ())
                out.append(bytes(
                    c if c >> 2 in (BLANK, DUPLICATE) or own not in known else (c & 3) + 4 * DUPLICATE
                    for c, own in zip(codes, idents)
                ))
            kept = ["conv_id", "seq", "first_turn", "last_turn", "turns"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(out, pa.binary())], names=[*kept, "codes"])

    light = cut.select("conv_id", "seq", "first_turn", "last_turn", "turns", "codes", "idents").join(marks, "seq", "left")
    return light.mapInArrow(run, "conv_id long, seq long, first_turn long, last_turn long, turns long, codes binary")


def _per_row(df: DataFrame, columns: list[str], function, fields: str) -> DataFrame:
    """``df`` with ``columns`` replaced by the ``fields`` that ``function`` makes of them."""
    made = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [function(*values) for values in zip(*(b.column(c).to_pylist() for c in columns))]
            rest = [n for n in b.schema.names if n not in columns]
            new = [pa.array([r[n] for r in out], t) for n, t in zip(made.names, made.types)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), *new], names=[*rest, *made.names])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in columns)
    return df.mapInArrow(run, f"{rest}, {fields}")


def _summary(codes: bytes) -> dict:
    """A block's cost from each state to each, and its counts."""
    far = [[FAR if s != t else 0 for s in range(4)] for t in range(4)]
    costs = [vectors(codes, tuple(v), 0, len(codes))[0] for v in far]  # by state at the end, then at the begin
    return {"costs": [costs[t][s] for s in range(4) for t in range(4)], "first_role": codes[0] & 3, "last_role": codes[-1] & 3,
            "illegal": illegal_pairs(codes)} | fault_counts(codes)


def _scan_back(group: pd.DataFrame) -> pd.DataFrame:
    """Checkpoints of one conversation: the vector at each block's end; the conversation's figures with its first block."""
    g = group.sort_values("seq").reset_index(drop=True)
    ends, now = [None] * len(g), list(AT_END)
    for i in range(len(g) - 1, -1, -1):
        ends[i] = now
        costs = g["costs"][i]
        now = [min(int(costs[4 * s + t]) + now[t] for t in range(4)) for s in range(4)]
    seams = sum((a, b) not in LEGAL for a, b in zip(g["last_role"][:-1], g["first_role"][1:]))
    known = [(int(f), int(t), int(n)) for f, t, n in zip(g["first_turn"], g["last_turn"], g["turns"]) if n]
    same = sum(a[1] == b[0] for a, b in zip(known, known[1:]))
    gaps = known[-1][1] - known[0][0] + 1 - (sum(n for _, _, n in known) - same) if known else 0
    out = pd.DataFrame({"conv_key": g["conv_key"], "seq": g["seq"], "after": ends, "last": [False] * (len(g) - 1) + [True]})
    figures = {"gaps": min(gaps, _LONG), "illegal": int(g["illegal"].sum()) + seams, "cost": now[START]}
    for c in COUNTS:
        value = figures[c] if c in figures else int(g[c].sum())
        out[c] = [value] + [0] * (len(g) - 1)
    return out


def _scan_on(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one conversation begins."""
    g = group.sort_values("seq").reset_index(drop=True)
    state, entries = START, []
    for exits in g["exits"]:
        entries.append(state)
        state = int(exits[state])
    return pd.DataFrame({"seq": g["seq"], "entry": entries})


def _cut_conversations(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired pieces of conversations in several blocks."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))  # a null id is a group too
    light = stage(_across(cut).withColumn("conv_key", key), "repair-codes")
    fields = (
        "costs array<bigint>, first_role int, last_role int, illegal long, blank long, duplicate long, truncated long"
    )
    keyed = light.select("conv_key", "seq", F.coalesce("first_turn", F.lit(0)).alias("first_turn"),
                         F.coalesce("last_turn", F.lit(0)).alias("last_turn"), "turns", "codes")
    figures = ", ".join(f"{c} long" for c in COUNTS)
    back = stage(
        _per_row(keyed, ["codes"], _summary, fields).groupBy("conv_key")
        .applyInPandas(_scan_back, f"conv_key string, seq long, after array<bigint>, last boolean, {figures}"),
        "repair-back",
    )
    ways = light.select("seq", "codes").join(back.select("seq", "after", "last"), "seq")
    exits = _per_row(
        ways, ["codes", "after", "last"],
        lambda codes, after, last: {"exits": [walk(codes, tuple(after), s, last)[1] for s in range(4)]}, "exits array<bigint>",
    )
    entries = exits.join(light.select("seq", "conv_key"), "seq").groupBy("conv_key").applyInPandas(_scan_on, "seq long, entry int")
    full = (
        light.select("seq", "codes").join(back.select("seq", "after", "last"), "seq").join(entries, "seq")
        .join(cut.select("conv_id", "seq", "roles", "texts"), "seq")
    )

    def edit(codes, after, last, entry, roles, texts):
        edits, _, _ = walk(codes, tuple(after), entry, last)
        return {"audit": "".join(edits), "repaired": repaired_lines(edits, roles, texts, entry)}

    pieces = stage(_per_row(full, ["codes", "after", "last", "entry", "roles", "texts"], edit, "audit string, repaired string"), "repair-pieces")
    audits = pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "audit"))), lambda p: p["audit"]), "").alias("audit")
    )
    sums = back.groupBy("conv_key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    ids = F.when(F.col("conv_key") != "", F.col("conv_key")).cast("long")
    summary = join_alike(sums.select(ids.alias("conv_id"), *COUNTS), audits, ["conv_id"])
    return summary, pieces.select("conv_id", "seq", "repaired")


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired conversations.

    The second table has (conv_id, seq, whole, repaired): pieces that in the order of ``seq``, those that are empty
    left out, are joined by newlines; a conversation that is ``whole`` is one piece.
    """
    cut_up = stage(blocks(rows, block), "repair-blocks")
    done = cut_up.where("whole")
    summary, pieces = _cut_conversations(cut_up.where("NOT whole"))
    return (
        done.select("conv_id", *COUNTS, "audit").unionByName(summary),
        done.select("conv_id", "seq", F.lit(True).alias("whole"), "repaired").unionByName(pieces.withColumn("whole", F.lit(False))),
    )


def text_digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). A hash is sequential: the pieces of one conversation pass one task, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun = None, None, False
        for b in batches:
            out = []
            for c, text in zip(b.column("conv_id").to_pylist(), b.column("repaired").to_pylist()):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, begun = c, hashlib.sha256(), False
                if text:
                    digest.update((b"\n" if begun else b"") + text.encode())
                    begun = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"]
            )
        if digest is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"]
            )

    one = pieces.where("whole").select("conv_id", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    many = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return one.unionByName(many.select("conv_id", "repaired").mapInArrow(run, "conv_id long, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of ``conv_id:turn``: dropped, emptied, without ends, repeated, or as a user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = (
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    )
    return (
        rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )


def with_all(conversations: DataFrame, summary: DataFrame, digests: DataFrame) -> DataFrame:
    """Every conversation given; one of which no row is left has zeros and an empty audit."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = join_alike(join_alike(ids, summary, ["conv_id"], "left"), digests, ["conv_id"], "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return found.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
