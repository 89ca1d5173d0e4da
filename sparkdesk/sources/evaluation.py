"""Prompt specifications and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkdesk.functions.grading import ASSERT_SCHEMA

_TURN = (
    f"id:string,category:string,prompt:string,promptGenerator:string,assert:{ASSERT_SCHEMA},review:string,appLevel:boolean"
)
CASE_SCHEMA = f"struct<{_TURN},conversation:array<struct<{_TURN}>>>"
RESULT_SCHEMA = (
    "id string, category string, text string, error string, ms long, inputTokens long, outputTokens long, cost double"
)


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of a specification file."""
    schema = T._parse_datatype_string(f"struct<version:string,model:string,cases:array<{CASE_SCHEMA}>>")
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("cases"))


def parse_cases(df: DataFrame, json: str) -> DataFrame:
    return df.select(F.from_json(json, CASE_SCHEMA).alias("c")).select("c.*")


def turns(cases: DataFrame) -> DataFrame:
    """One row per turn: those of a case's conversation, else the case itself."""
    names = [c for c in cases.columns if c != "conversation"]
    own = F.array(F.struct(*names))
    return cases.select(F.inline(F.coalesce("conversation", own)))


def latest_results(spark: SparkSession, root: str) -> DataFrame:
    """The newest ``raw-*.jsonl`` under ``root`` (names carry their time stamp).
    Only the listing is read to choose it."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = F.struct(
        F.regexp_extract("path", r"/(raw-[^/]*\.jsonl)(?:/|$)", 1).alias("name"),
        F.regexp_extract("path", r"^(.*/raw-[^/]*\.jsonl)(?:/|$)", 1).alias("place"),
    )
    newest = listing.select(found.alias("f")).where("f.name <> ''").agg(F.max("f")).first()[0]
    if not newest:
        raise FileNotFoundError(f"no raw-*.jsonl under {root}")
    return spark.read.schema(RESULT_SCHEMA).json(newest["place"])
