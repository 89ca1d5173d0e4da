"""The usage ledger kept by a stream.

Events add to the month they carry. There is no late-data rule: a total per
(month, category, provider) is kept for good, so the state grows with months
and providers, not with events, and needs no watermark.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkdesk.operators.usage import counted, money, month_of

KEYS = ["month", "category", "provider"]
COMPACT_EVERY = 16  # batches that are folded into a snapshot
LEDGER_COLUMNS = "month string, category string, provider string, count long, input_tokens long, output_tokens long, cost double"


def running_ledger(costed: DataFrame) -> DataFrame:
    """Totals per key over a stream of events that were priced as they arrived."""
    return (
        counted(costed)
        .groupBy(month_of("ts").alias("month"), F.col("kind").alias("category"), "provider")
        .agg(
            F.sum("units").alias("count"), F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
        )
    )


def _folder(spark: SparkSession, path: str):
    """Hadoop's view of a folder: works wherever Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers N of entries ``batch=N`` or ``upto=N`` in a folder."""
    system, at = _folder(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.partition("=")[2].isdigit())


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    """(ledger, batch) of the snapshot that the newest pointer names and of the batches after it."""
    commits = _numbers(spark, f"{path}/commits")
    upto = commits[-1] if commits else -1
    parts = [spark.read.schema(LEDGER_COLUMNS + ", batch long").parquet(f"{path}/snapshots/upto={upto}")] if commits else []
    for n in _numbers(spark, f"{path}/deltas"):
        if n > upto:
            parts.append(spark.read.schema(LEDGER_COLUMNS).parquet(f"{path}/deltas/batch={n}").withColumn("batch", F.lit(n).cast("long")))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def _newest(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c not in (*KEYS, "batch")]
    return rows.groupBy(*KEYS).agg(F.max(F.struct("batch", *values)).alias("v")).select(*KEYS, *[F.col(f"v.{c}") for c in values], F.col("v.batch"))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Fold the batches up to ``upto`` into a snapshot, then point to it, then drop what it replaces.

    The pointer is written last, as an empty file of its own, so a reader sees
    the old state or the new one. After a failure anywhere before it the old
    snapshot and all its batches are still there; a repeat writes the same again.
    """
    commits = _numbers(spark, f"{path}/commits")
    if commits and commits[-1] >= upto:
        return
    _newest(_rows(spark, path).where(F.col("batch") <= upto)).write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
    system, at = _folder(spark, f"{path}/commits/upto={upto}")
    system.create(at, True).close()
    for kind, name in (("deltas", "batch"), ("snapshots", "upto"), ("commits", "upto")):
        for n in _numbers(spark, f"{path}/{kind}"):
            if n < upto or (n == upto and kind == "deltas"):
                system.delete(_folder(spark, f"{path}/{kind}/{name}={n}")[1], True)


def write_batch(path: str, compact_every: int = COMPACT_EVERY):
    """A sink that may be called again for a batch it already wrote.

    Each batch has a folder of its own, which is replaced: after a failure the
    stream repeats the batch, and the repeat takes the failed attempt's place.
    Rows hold totals so far, not additions, so nothing is counted twice. Every
    ``compact_every`` batches they are folded into one snapshot, so that a
    reader opens one snapshot and fewer batches than that, however long the
    stream has run. A batch that a snapshot holds already is not written again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commits = _numbers(spark, f"{path}/commits")
        if commits and commits[-1] >= batch_id:
            return
        batch.write.mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(spark, path, batch_id)

    return write


def start_ledger(ledger: DataFrame, path: str, checkpoint: str, sink=None, **trigger) -> StreamingQuery:
    return (
        ledger.writeStream.outputMode("update")
        .foreachBatch(sink or write_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of every key."""
    rows = _rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], LEDGER_COLUMNS)
    return _newest(rows).drop("batch").withColumn("cost", money(F.col("cost")))
