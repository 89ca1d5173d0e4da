"""Connection captures: tab-separated rows under ``#`` comments and a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(phase, time, source, remote); header lines may repeat."""
    return (
        spark.read.schema("phase string, time string, source string, remote string")
        .csv(path, sep="\t", comment="#")
        .where("phase <> 'phase'")
    )
