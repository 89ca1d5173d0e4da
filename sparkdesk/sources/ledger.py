"""The stored ledger: months of totals per category, and per provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_TOTAL = "struct<input_tokens:bigint,output_tokens:bigint,images:bigint,searches:bigint,cost:double>"
_TALLY = "map<string,struct<count:bigint,cost:double>>"
LEDGER_SCHEMA = (
    "struct<months:map<string,struct<"
    f"ai:{_TOTAL},image:{_TOTAL},search:{_TOTAL},image_by_provider:{_TALLY},search_by_provider:{_TALLY}>>,"
    "merged_legacy:boolean>"
)


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    schema = T._parse_datatype_string(LEDGER_SCHEMA)
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(F.col("_metadata.file_name").alias("ledger_id"), F.struct(*schema.names).alias("ledger"))
    )


def parse_ledgers(df: DataFrame, ledger_id: str, json: str) -> DataFrame:
    return df.select(F.col(ledger_id).alias("ledger_id"), F.from_json(json, LEDGER_SCHEMA).alias("ledger"))


def ledger_rows(ledgers: DataFrame) -> DataFrame:
    """(ledger_id, month, category, provider, count, input_tokens, output_tokens, cost).

    ``provider`` is null on category totals. An absent field counts as zero.
    """
    month = ledgers.select("ledger_id", F.explode("ledger.months").alias("month", "m"))
    zero = F.lit(0).cast("long")

    def total(kind: str, count):
        c = F.col(f"m.{kind}")
        return F.when(c.isNotNull(), F.struct(
            F.lit(kind).alias("category"), F.lit(None).cast("string").alias("provider"),
            F.coalesce(count, zero).alias("count"),
            F.coalesce(c["input_tokens"], zero).alias("input_tokens"),
            F.coalesce(c["output_tokens"], zero).alias("output_tokens"),
            F.coalesce(c["cost"], F.lit(0.0)).alias("cost"),
        ))

    def tallies(kind: str):
        entries = F.coalesce(F.map_entries(f"m.{kind}_by_provider"), F.array())
        return F.transform(entries, lambda e: F.struct(
            F.lit(kind).alias("category"), e["key"].alias("provider"),
            F.coalesce(e["value"]["count"], zero).alias("count"),
            zero.alias("input_tokens"), zero.alias("output_tokens"),
            F.coalesce(e["value"]["cost"], F.lit(0.0)).alias("cost"),
        ))

    totals = F.array_compact(F.array(
        total("ai", zero), total("image", F.col("m.image.images")), total("search", F.col("m.search.searches"))
    ))
    return month.select(
        "ledger_id", "month", F.inline(F.concat(totals, tallies("image"), tallies("search")))
    )
