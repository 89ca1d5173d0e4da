"""Ordered computations that survive a hot key.

A window partitioned by key puts a key's whole history into one task. Here each
key is cut into blocks of consecutive positions: a window runs inside every
(key, block), each block is summarised with a partial aggregate, the summaries
(one row per block) are scanned per key, and the two are joined on (key, block).
No task ever sees more than a block of rows, or one row per block of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536
_BLOCK = "__block"

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


@dataclass(frozen=True)
class Scan:
    """One output column: ``kind`` is sum, count, max or min; ``frame`` is
    ``before`` / ``upto`` (preceding rows without / with the current one),
    ``after`` / ``onward`` (following rows without / with it) or ``total``."""

    name: str
    kind: str
    value: Column
    frame: str = "upto"


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    # written out because greatest() and least() do not order structs
    first = (a >= b) if kind == "max" else (a <= b)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(first, a).otherwise(b)


def block_of(position: Column, size: int = BLOCK) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column | str,
    scans: Sequence[Scan],
) -> DataFrame:
    """Add the ``scans`` columns, evaluated per key in ``order``.

    Keys are never null; ``block`` must not decrease along ``order`` in a key. ``max`` and
    ``min`` take structs, so ``max(struct(position, value))`` over the rows
    before is a lag, or a carried-forward value. Scans that share a ``block``
    column, given by name, share its partitioning.
    """
    values = {s.name: f"__v_{s.name}" for s in scans}
    by = block if isinstance(block, str) else _BLOCK
    wide = df if isinstance(block, str) else df.withColumn(by, block)
    for s in scans:
        wide = wide.withColumn(values[s.name], s.value)

    summary = wide.groupBy(*keys, by).agg(
        *[_AGG[s.kind](values[s.name]).alias(f"__s_{s.name}") for s in scans]
    )
    per_key = Window.partitionBy(*keys).orderBy(by)
    past = per_key.rowsBetween(Window.unboundedPreceding, -1)
    future = per_key.rowsBetween(1, Window.unboundedFollowing)
    combine = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    offsets = []
    for s in scans:
        partial = F.col(f"__s_{s.name}")
        if s.frame in ("before", "upto"):
            offsets.append(combine[s.kind](partial).over(past))
        elif s.frame in ("after", "onward"):
            offsets.append(combine[s.kind](partial).over(future))
        else:
            offsets.append(combine[s.kind](partial).over(Window.partitionBy(*keys)))
    summary = summary.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(by).alias("__kb"),
        *[o.alias(f"__o_{s.name}") for s, o in zip(scans, offsets)],
    )

    inside = Window.partitionBy(*keys, by).orderBy(*order)
    frames = {
        "before": inside.rowsBetween(Window.unboundedPreceding, -1),
        "upto": inside.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        "after": inside.rowsBetween(1, Window.unboundedFollowing),
        "onward": inside.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    }
    local = wide
    for s in scans:
        if s.frame != "total":
            local = local.withColumn(f"__l_{s.name}", _AGG[s.kind](values[s.name]).over(frames[s.frame]))

    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    joined = local.join(summary, on + [F.col(by) == F.col("__kb")], "left")
    out = []
    for s in scans:
        if s.frame == "total":
            value = F.col(f"__o_{s.name}")
        else:
            value = _merge(s.kind, F.col(f"__o_{s.name}"), F.col(f"__l_{s.name}"))
        if s.kind in ("sum", "count"):
            value = F.coalesce(value, F.lit(0))
        out.append(value.alias(s.name))
    return joined.select(*[F.col(c) for c in df.columns], *out)


def order_statistic(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rank: Column,
    bucket_width: float,
    out: str,
) -> DataFrame:
    """The value at 0-based ``rank`` of each key's sorted values, exactly, and the ``largest``.

    ``rank`` may use ``n``, the key's row count. Equal values are counted
    before anything is ordered; totals per bucket of values are then walked to
    find the one bucket that holds the rank, and only that bucket is sorted.
    """
    by = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", F.floor(F.col("__x") / F.lit(bucket_width)).cast("long"))
    )
    w = Window.partitionBy(*by).orderBy("__b")
    buckets = (
        counts.groupBy(*by, "__b")
        .agg(F.sum("__n").alias("__bn"), F.max("__x").alias("__bm"))
        .withColumn("largest", F.max("__bm").over(Window.partitionBy(*by)))
        .withColumn("n", F.sum("__bn").over(Window.partitionBy(*by)))
        .withColumn("__before", F.sum("__bn").over(w) - F.col("__bn"))
        .withColumn("__rank", rank)
        .where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__bn")))
        .select(*by, "__b", "n", "largest", "__before", "__rank")
    )
    inner = Window.partitionBy(*by, "__b").orderBy("__x")
    return (
        counts.join(buckets, by + ["__b"])
        .withColumn("__upto", F.col("__before") + F.sum("__n").over(inner))
        .where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
        .select(*by, "n", F.col("__x").alias(out), "largest")
    )
