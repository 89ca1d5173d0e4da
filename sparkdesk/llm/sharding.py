"""Shards cut from a Hilbert curve through several metadata dimensions.

Every dimension is quantised to ``BITS`` bits: a number by the quantiles of all
rows, a category by its hash. Rows are sorted by their index on the Hilbert
curve through these cells and cut into runs of equal length, so that a shard,
and each run of slots inside it, covers a compact box of the dimensions and
files are pruned by the smallest and largest value of any of them.

Inside a cell rows follow their text's checksum and id, so a cell that holds a
third of all rows is cut like any other. The rank of a row is its place in its
sorted range plus the rows of the ranges before; no row meets all others.

Defined results: a null text has size 1 (no bytes plus 1) and checksum 0; nulls
of a dimension share its first cell; repeated rows and ids are rows of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import offsets, stage

BITS = 6
ACCURACY = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), each below 2**bits.

    The axes are turned into the curve's transposed bits from the top down: a set
    bit inverts the lower bits of the first axis, a clear one exchanges them.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        t ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(level)) & one)
    return out.astype(np.int64)


def with_curve(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], bits: int = BITS) -> DataFrame:
    """Add ``curve``, the Hilbert index of the given columns."""
    cuts = {}
    if numbers:
        shares = [i / (1 << bits) for i in range(1, 1 << bits)]
        found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY).alias(c) for c in numbers]).first()
        cuts = {c: np.unique(found[c] or []) for c in numbers}  # 2**bits - 1 values each
    hashed = [F.shiftrightunsigned(F.xxhash64(c), 64 - bits).alias(c) for c in categories]

    @F.pandas_udf("long")
    def place(axes: pd.DataFrame) -> pd.Series:
        cells = [np.searchsorted(cuts[c], axes[c].to_numpy(dtype=float, na_value=-np.inf), side="right") for c in numbers]
        cells += [axes[c].to_numpy() for c in categories]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits)) if len(axes) else pd.Series([], dtype="int64")

    return df.withColumn("curve", place(F.struct(*[F.col(c).cast("double").alias(c) for c in numbers], *hashed)))


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; counts differ by one at most."""
    text = F.encode("text", "utf-8")
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), "lang", "source",
    )
    light = stage(light, "shard-rows")
    placed = with_curve(light, ["size"], ["lang", "source"])
    ordered = placed.select("doc_id", "size", "text_crc32", "curve").repartitionByRange("curve", "text_crc32", "doc_id")
    ordered = ordered.sortWithinPartitions("curve", "text_crc32", "doc_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            more = [pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "part", "pos"])
            pos += n

    schema = "doc_id long, size long, text_crc32 long, curve long, part int, pos long"
    runs = stage(ordered.mapInArrow(number, schema), "shard-runs")
    counts = runs.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = runs.count()
    rank = F.col("before") + F.col("pos")
    # the first (total mod shards) shards have one row more
    small, longer = divmod(total, shards)
    edge = longer * (small + 1)
    shard = F.when(rank < edge, F.expr(f"(before + pos) div {small + 1}"))
    slot = F.when(rank < edge, rank % (small + 1))
    if small:
        shard = shard.otherwise(F.expr(f"(before + pos - {edge}) div {small} + {longer}"))
        slot = slot.otherwise((rank - edge) % small)
    return (
        runs.join(offsets(counts, "part", "n", "before"), "part")
        .select("doc_id", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as Parquet files in folders ``shard=n``, in slot order inside each file.

    ``doc_id`` has to be unique. Long shards become several files, each a range of slots.
    """
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
