"""Stored conversations: one JSON object each, exploded to messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ATTACHMENT = "struct<kind:string,name:string,content:string,dataUrl:string>"
MESSAGE = (
    f"struct<role:string,text:string,content:string,attachments:array<{ATTACHMENT}>,at:bigint,"
    "sentAs:string,steps:string,image:string>"
)
CONVERSATION_SCHEMA = (
    "struct<schema:int,id:string,title:string,title_custom:boolean,updated_at:string,project_id:string,"
    f"messages:array<{MESSAGE}>>"
)
CURRENT_SCHEMA = 1


def read_conversations(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per conversation that can be read; ``refused_conversations`` has the others."""
    return _parsed(spark, path, one_per_file).where("__refused IS NULL").drop("__refused", "__file")


def refused_conversations(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """(file, reason, id, title) of conversations that cannot be parsed, or that a newer version wrote."""
    return _parsed(spark, path, one_per_file).where("__refused IS NOT NULL").select(
        F.col("__file").alias("file"), F.col("__refused").alias("reason"), "id", "title"
    )


def _parsed(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    schema = T._parse_datatype_string(CONVERSATION_SCHEMA).add("__broken", "string")
    rows = (
        spark.read.schema(schema).option("multiLine", one_per_file).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "__broken").json(path)
    )
    reason = F.when(F.col("__broken").isNotNull(), "not readable").when(F.col("schema") > CURRENT_SCHEMA, "newer version")
    return rows.select(*schema.names[:-1], reason.alias("__refused"), F.col("_metadata.file_path").alias("__file"))


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, attachments, at, sent_as, steps, has_image)."""
    return conversations.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.coalesce("m.text", F.lit("")).alias("text"),
        "m.attachments", "m.at", F.col("m.sentAs").alias("sent_as"), "m.steps", F.col("m.image").isNotNull().alias("has_image"),
    )
