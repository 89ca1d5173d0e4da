"""The queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm.binary_ids import round_trip
from sparkdesk.llm.common import read
from sparkdesk.llm import exact_search, graph_search, lm_scoring, repair, runs
from sparkdesk.llm.mixing import mix, token_count
from sparkdesk.llm.near_dup import near_duplicates
from sparkdesk.llm.packing import pack
from sparkdesk.llm.sharding import hilbert_shards
from sparkdesk.llm.token_counts import count_tokens
from sparkdesk.llm.tokens import vocabulary
from sparkdesk.llm.toxicity import score_documents
from sparkdesk.llm.url_filter import judge_urls


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op3_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's number in its URL is its document's: low quality or toxic is to be blocked."""
    pages = read(spark, sf_dir, "pages")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') as bigint)")
    labels = (
        pages.select("page_id", number.alias("doc_id"))
        .join(read(spark, sf_dir, "labels").select("doc_id", bad.alias("blocked")), "doc_id").select("page_id", "blocked")
    )
    return judge_urls(pages, labels)


DOMAINS = ["domain", "lang", "source"]


def tree_levels(docs: DataFrame) -> DataFrame:
    """Documents with their words counted and a domain, one of four that sources fall into."""
    domain = F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(4)).cast("string"))
    return docs.withColumn("domain", domain).withColumn("n_tokens", token_count())


def tree_weights() -> list:
    """Domain 0 is to give twice the share of another, English as much as all other languages of its domain."""
    return [
        F.when(F.col("domain") == "domain0", 2.0).otherwise(1.0), F.when(F.col("lang") == "en", 3.0).otherwise(1.0), F.lit(1.0),
    ]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(tree_levels(read(spark, sf_dir, "documents")), DOMAINS, tree_weights())


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"))


def op9_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores with a context of two words, so that backing off has two steps."""
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"), order=3)


def op10_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    summary, pieces = repair.repair(repair.damaged(rows))
    return repair.with_all(rows, summary, repair.text_digests(pieces))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return runs.run_digests(runs.find_runs(docs.select(doc_id, runs.repeat_passage(doc_id, F.col("text")).alias("text"))))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_hilbert": op2_hilbert,
    "op3_dual_tree": op3_dual_tree,
    "op4_minhash": op4_minhash,
    "op5_binary_ids": op5_binary_ids,
    "op6_toxicity": op6_toxicity,
    "op7_url_rules": op7_url_rules,
    "op8_mixing": op8_mixing,
    "op9_backoff": op9_backoff,
    "op9_trigrams": op9_trigrams,
    "op10_graph": op10_graph,
    "op11_repair": op11_repair,
    "op12_runs": op12_runs,
    "op13_token_counts": op13_token_counts,
}
OP3 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM e) q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op3_dual_tree": OP3, "op9_backoff": lm_scoring.ORACLE}
