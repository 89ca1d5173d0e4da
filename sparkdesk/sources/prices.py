"""Price tables: one JSON object each, exploded to rates and exchange rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkdesk.plans.prices import MAX_PRICE_FILE_BYTES, PRICE_LIST

_TOKEN_RATE = "struct<input_per_mtok:double,output_per_mtok:double,currency:string>"
_UNIT_RATE = "struct<per_unit:double,currency:string>"
PRICE_SCHEMA = (
    "struct<version:string,collected:string,display_currency:string,fx:map<string,double>,"
    f"ai:map<string,{_TOKEN_RATE}>,image:map<string,{_UNIT_RATE}>,search:map<string,{_UNIT_RATE}>,"
    "sources:map<string,string>,free:map<string,string>>"
)


def read_price_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``table_id`` is the file name, ``price`` the table.
    A file above the size a price list may have gives a row without a table,
    marked ``oversized``."""
    schema = T._parse_datatype_string(PRICE_SCHEMA)
    oversized = F.col("_metadata.file_size") > MAX_PRICE_FILE_BYTES
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.col("_metadata.file_name").alias("table_id"), oversized.alias("oversized"), F.struct(*schema.names).alias("price"))
        .select("table_id", F.when(~F.col("oversized"), F.col("price")).alias("price"), "oversized")
    )


def parse_price_tables(df: DataFrame, table_id: str, json: str) -> DataFrame:
    oversized = F.octet_length(json) > MAX_PRICE_FILE_BYTES
    return df.select(
        F.col(table_id).alias("table_id"), F.when(~oversized, F.from_json(json, PRICE_SCHEMA)).alias("price"),
        F.coalesce(oversized, F.lit(False)).alias("oversized"),
    )


def rates(tables: DataFrame) -> DataFrame:
    """(table_id, kind, name, input_per_mtok, output_per_mtok, per_unit, currency); EUR where none is named."""
    token = tables.select("table_id", F.lit("ai").alias("kind"), F.explode("price.ai").alias("name", "r")).select(
        "table_id", "kind", "name", "r.input_per_mtok", "r.output_per_mtok",
        F.lit(None).cast("double").alias("per_unit"), F.coalesce("r.currency", F.lit("EUR")).alias("currency"),
    )
    unit = tables.select(
        "table_id",
        F.explode(F.array(
            F.struct(F.lit("image").alias("kind"), F.col("price.image").alias("m")),
            F.struct(F.lit("search").alias("kind"), F.col("price.search").alias("m")),
        )).alias("g"),
    ).select("table_id", "g.kind", F.explode("g.m").alias("name", "r")).select(
        "table_id", "kind", "name",
        F.lit(None).cast("double").alias("input_per_mtok"), F.lit(None).cast("double").alias("output_per_mtok"),
        "r.per_unit", F.coalesce("r.currency", F.lit("EUR")).alias("currency"),
    )
    return token.unionByName(unit)


def exchange(tables: DataFrame) -> DataFrame:
    """(table_id, currency, mult)."""
    return tables.select("table_id", F.explode("price.fx").alias("currency", "mult"))


def current_price_list(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Rates and exchange rates of the list in force."""
    one = spark.range(0, 1, 1, 1).select(F.lit("current").alias("id"), F.lit(PRICE_LIST).alias("json"))
    tables = parse_price_tables(one, "id", "json")
    return rates(tables).drop("table_id"), exchange(tables).drop("table_id")
