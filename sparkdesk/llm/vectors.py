"""Vectors as rows: validity, and cells of near vectors of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: str) -> Column:
    """Whether a vector is not null, not empty and holds finite numbers only."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def filled(lists: pd.Series, width: int) -> np.ndarray:
    """Rows of arrays as doubles; shorter vectors are filled with zeros."""
    sizes = lists.map(len).to_numpy()
    flat = np.concatenate([*lists, []]).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def spread_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of the smallest hashed keys: a bounded sample that is the same in every run."""
    return df.orderBy(F.xxhash64(key), key).limit(limit)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` centres far from each other, from a bounded sample."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen]
    for _ in range(4):  # a few rounds of means even the cells out
        own = nearest(sample, centres)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = sample[own == i].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def with_cells(df: DataFrame, vector: str, key: str, centres: np.ndarray, size: int) -> DataFrame:
    """Add ``cell``: the nearest centre, cut by hashed key so that a cell keeps to ``size`` rows or so.

    A centre with a third of all rows, such as one vector that repeats, is cut like any other.
    """
    width = centres.shape[1]
    schema = df.schema.simpleString()[len("struct<") : -1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest(matrix(b.column(vector), width), centres) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "centre"])

    placed = df.mapInArrow(place, f"{schema}, centre: bigint")
    counts = placed.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))  # one row per centre
    cuts = {r["centre"]: -(-r["n"] // size) for r in counts.collect()}
    first, total = {}, 0
    for c in sorted(cuts):
        first[c] = total
        total += cuts[c]
    if not total:
        return placed.withColumn("cell", F.lit(0).cast("long")).drop("centre")
    table = F.create_map(*[F.lit(v) for c in sorted(cuts) for v in (c, first[c] * 2**20 + cuts[c])])
    code = F.element_at(table, F.col("centre"))
    part = F.pmod(F.xxhash64(key), F.pmod(code, F.lit(2**20)))
    return placed.withColumn("cell", (F.floor(code / F.lit(2**20)) + part).cast("long")).drop("centre")
