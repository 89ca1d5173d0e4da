"""What several training-data operators share: tables, staging and running offsets."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkdesk.session import new_path

_BLOCK = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work done once, lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_alike(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys in which null equals null; the keys come from ``left``."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, same, how).drop(*[f"__r_{c}" for c in on])


def offsets(parts: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """(order, out): the sum of ``value`` over all smaller ``order`` values.

    ``parts`` has one row per task or file, so no row count of the data itself.
    Blocks of 4,096 are summed first and only their totals meet in one task.
    """
    blocks = parts.groupBy(F.floor(F.col(order) / F.lit(_BLOCK)).alias("__b")).agg(F.sum(value).alias("__s"))
    before = blocks.select(
        "__b", (F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__o")
    )
    inside = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.select(order, value, F.floor(F.col(order) / F.lit(_BLOCK)).alias("__b"))
        .withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(before, "__b")
        .select(order, (F.col("__i") + F.col("__o")).cast("long").alias(out))
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for functions that run in Python tasks."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"  # served to executors by the driver
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
