"""Toxicity, near duplicates, mixing and packing over ``documents``, stage by stage.

Each stage works on all rows its predecessor kept, and returns the columns of
``documents`` but for the last. Nulls in any column, empty and very long texts,
repeated rows and an empty table are handled as the operators say; columns
beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm.common import join_alike, read, stage
from sparkdesk.llm.mixing import first_tokens, mix
from sparkdesk.llm.near_dup import near_duplicates
from sparkdesk.llm.packing import pack
from sparkdesk.llm.queries import DOMAINS, tree_levels, tree_weights
from sparkdesk.llm.tokens import vocabulary
from sparkdesk.llm.toxicity import THRESHOLD, fold, train, with_score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold; null and empty texts do."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold() != 2)
    scored = with_score(docs.select(COLUMNS), train(docs.select(COLUMNS), labels))
    return scored.where(F.col("score") < THRESHOLD).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows that share this id stay with each of their different texts, one row of
    each; rows without an id stay all.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    texts = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("__text"))
    chosen = texts.agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("__row"))
    return chosen.select("__row.*").unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's epochs take them, as many words in all as came in.

    The last document of a leaf is cut after the words its budget still has.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    light = tree_levels(keyed).select(*DOMAINS, "doc_id", "n_tokens", "row_key")
    taken = mix(light, DOMAINS, tree_weights(), keep=["row_key"]).select("doc_id", "row_key", "n_tokens", "taken")
    rows = join_alike(taken, keyed.dropDuplicates(["doc_id", "row_key"]), ["doc_id", "row_key"])
    cut = F.col("taken") < F.col("n_tokens")
    text = F.when(cut, first_tokens(F.col("text"), F.col("taken"))).otherwise(F.col("text"))
    return rows.select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 ids from every document that is left."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
# label models, sketches and token ids are beyond SQL: the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
