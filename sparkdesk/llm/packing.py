"""Packing documents into windows by non-negative least squares over their lengths.

A document is its token ids and an end id. Whole windows are cut from its front;
what is left has a length below the window, so all lengths fit one histogram of
``window`` bins whatever the input. Combinations of two or three lengths that
fill a window exactly are enumerated, their repeat counts solved against the
histogram and rounded down to what is there. The pieces that remain are laid end
to end, each window filled before the next is opened, and cut at its edge.

Only the histogram and the plan (both bounded by the window) are on the driver.
A piece finds its place from its length and its rank among pieces of that length.

Defined results: a null or empty text is its end id alone; repeated rows and
repeated ids are documents of their own; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkdesk.llm.common import offsets, stage
from sparkdesk.llm.tokens import encoder

WINDOW = 2048
ANCHORS = 32  # most frequent lengths that triples are built around
SWEEPS = 8

_SHIFT = 1 << 44
_ENCODED = (
    "doc_id long, part int, pos long, doc_tokens long, full_crcs array<long>, full_local long, "
    "tail_len int, tail_crc long, tail_local long, tail binary"
)
_PLACED = (
    "doc_id long, part int, pos long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, skip int, whole boolean"
)


def encode_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """One row per document: checksums of its whole windows, and the ids after the last of them.

    ``full_local`` and ``tail_local`` count the windows, and the tails of the same
    length, that the same task saw before.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, "words")
        part, pos, fulls, tails = TaskContext.get().partitionId(), 0, 0, {}
        for batch in batches:
            rows = {k: [] for k in ("doc_tokens", "full_crcs", "full_local", "tail_len", "tail_crc", "tail_local", "tail")}
            for ids in enc.ids(batch.column("text").to_pylist()):
                ids += end
                n = len(ids) // 4
                whole, rest = divmod(n, window)
                tail = ids[whole * step :]
                rows["doc_tokens"].append(n)
                rows["full_crcs"].append([zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(whole)])
                rows["full_local"].append(fulls)
                rows["tail_len"].append(rest)
                rows["tail_crc"].append(zlib.crc32(tail))
                rows["tail_local"].append(tails.get(rest, 0))
                rows["tail"].append(tail)
                fulls += whole
                tails[rest] = tails.get(rest, 0) + 1
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array([part] * size, pa.int32()),
                    pa.array(range(pos, pos + size), pa.int64()), pa.array(rows["doc_tokens"], pa.int64()),
                    pa.array(rows["full_crcs"], pa.list_(pa.int64())), pa.array(rows["full_local"], pa.int64()),
                    pa.array(rows["tail_len"], pa.int32()), pa.array(rows["tail_crc"], pa.int64()),
                    pa.array(rows["tail_local"], pa.int64()), pa.array(rows["tail"], pa.binary()),
                ],
                names=[f.split()[0] for f in _ENCODED.split(", ")],
            )
            pos += size

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


@dataclass
class Plan:
    """Where the pieces of each (length, rank) go.

    ``keys`` holds length * 2**44 + first rank of an interval, ascending; an
    interval with ``first`` -1 belongs to the residual laid end to end from
    ``place``, others to one slot of a pattern.
    """

    keys: np.ndarray
    first: np.ndarray
    place: np.ndarray
    residual_from: int
    whole: int
    residual: int


def exact_fills(counts: np.ndarray, window: int, anchors: int = ANCHORS) -> list[tuple[int, ...]]:
    """Pairs, and triples around the most frequent lengths, that fill the window."""
    present = counts > 0
    fills = [(a, window - a) for a in range(1, window // 2 + 1) if present[a] and present[window - a]]
    top = [int(a) for a in np.argsort(-counts[1:], kind="stable")[:anchors] + 1 if present[a]]
    triples = set()
    for a in top:
        for b in range(1, window - a):
            c = window - a - b
            if b <= c and present[b] and present[c]:
                triples.add(tuple(sorted((a, b, c))))
    return fills + sorted(triples)


def solve_counts(counts: np.ndarray, fills: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit the histogram, by coordinate descent."""
    left = counts.astype(float).tolist()
    x = [0.0] * len(fills)
    norms = [float(sum(v * v for v in np.unique(f, return_counts=True)[1])) for f in fills]
    for _ in range(sweeps):
        for i, f in enumerate(fills):
            step = 0.0
            for length in f:
                step += left[length]
            new = x[i] + step / norms[i]
            if new < 0.0:
                new = 0.0
            moved = new - x[i]
            if moved:
                for length in f:
                    left[length] -= moved
                x[i] = new
    return np.array(x)


def make_plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """``counts[l]`` pieces of each length 1..window; those of ``window`` are sequences by themselves."""
    fills = exact_fills(counts[:window], window)
    solved = solve_counts(counts[:window], fills)
    used = np.zeros(window + 1, dtype=np.int64)
    rows = [(window, 0, 0, 0)]
    sequences = int(counts[window])
    for i in np.argsort(-solved, kind="stable"):
        fill, wanted = fills[i], int(solved[i] + 0.5)
        lengths, times = np.unique(fill, return_counts=True)
        wanted = min(wanted, *((counts[lengths] - used[lengths]) // times).tolist())
        if wanted <= 0:
            continue
        offset = 0
        for length in fill:
            rows.append((length, int(used[length]), sequences, offset))
            used[length] += wanted
            offset += length
        sequences += wanted
    place = 0
    for length in range(window - 1, 0, -1):
        left = int(counts[length] - used[length])
        if left > 0:
            rows.append((length, int(used[length]), -1, place))
            place += left * length
    rows.sort()
    table = np.array(rows, dtype=np.int64)
    return Plan(table[:, 0] * _SHIFT + table[:, 1], table[:, 2], table[:, 3], sequences, sequences, place)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence is full, but for the last.
    """
    encoded = stage(encode_documents(docs, vocabulary, window, end_id), "packing")
    tails = encoded.where("tail_len > 0").groupBy("tail_len", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = tails.groupBy("tail_len").agg(F.sum("n").alias("n")).collect()  # at most window - 1 rows
    per_part = encoded.groupBy("part").agg(F.sum(F.size("full_crcs")).cast("long").alias("n"))
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in histogram:
        counts[r["tail_len"]] = r["n"]
    counts[window] = per_part.agg(F.sum("n")).first()[0] or 0
    plan = make_plan(counts, window)

    before = Window.partitionBy("tail_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tail_from = tails.select("tail_len", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tail_from"))
    light = (
        encoded.drop("tail")
        .join(offsets(per_part, "part", "n", "full_from"), "part")
        .join(tail_from, ["tail_len", "part"], "left")
    )
    placed = light.mapInArrow(lambda batches: (_placed(b, plan, window) for b in batches), _PLACED)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = (
        placed.where("NOT whole")
        .join(encoded.select("part", "pos", "tail"), ["part", "pos"])
        .withColumn("ids_crc32", F.crc32(F.substr("tail", F.col("skip") * 4 + 1, (F.col("length") * 4).cast("int"))))
    )
    return placed.where("whole").select(columns).unionByName(cut.select(columns))


def _placed(batch: pa.RecordBatch, plan: Plan, window: int) -> pa.RecordBatch:
    f = _place(batch.drop_columns(["doc_id"]).to_pandas().assign(row=range(batch.num_rows)), plan, window)
    ids = batch.column("doc_id").take(pa.array(f.pop("row"), pa.int64()))  # may hold nulls, so never in pandas
    types = {"part": pa.int32(), "skip": pa.int32(), "whole": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(f[c].to_numpy(), types.get(c, pa.int64())) for c in f.columns)], names=["doc_id", *f.columns]
    )


def _place(f: pd.DataFrame, plan: Plan, window: int) -> pd.DataFrame:
    wholes = f["full_crcs"].map(len).to_numpy()
    at = np.repeat(np.arange(len(f)), wholes)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(wholes) - wholes, wholes)
    full = f.iloc[at][["row", "part", "pos", "doc_tokens"]].assign(
        start=nth * window, length=window,
        ids_crc32=np.concatenate([*f["full_crcs"], []]).astype(np.int64),
        sequence_id=(f["full_from"] + f["full_local"]).to_numpy()[at] + nth, offset=0, skip=0, whole=True,
    )
    t = f[f["tail_len"] > 0]
    length = t["tail_len"].to_numpy().astype(np.int64)
    rank = t["tail_from"].to_numpy().astype(np.int64) + t["tail_local"].to_numpy()
    i = np.searchsorted(plan.keys, length * _SHIFT + rank, side="right") - 1
    nth = rank - plan.keys[i] % _SHIFT
    place = plan.place[i] + nth * length
    slot = plan.first[i] >= 0
    sequence = np.where(slot, plan.first[i] + nth, plan.residual_from + place // window)
    offset = np.where(slot, plan.place[i], place % window)
    cut = offset + length > window
    first = np.where(cut, window - offset, length)
    tail = t[["row", "part", "pos", "doc_tokens"]].assign(
        start=t["doc_tokens"].to_numpy() - length, length=first, ids_crc32=t["tail_crc"], sequence_id=sequence,
        offset=offset, skip=0, whole=~cut,
    )
    rest = tail[cut].assign(
        start=lambda x: x["start"] + x["length"], length=(length - first)[cut], sequence_id=sequence[cut] + 1,
        offset=0, skip=first[cut],
    )
    return pd.concat([full, tail, rest])[["row", *(c.split()[0] for c in _PLACED.split(", ")[1:])]]
