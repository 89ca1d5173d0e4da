"""Inputs derived from the given tables, in SQL that Spark and DuckDB both accept.

Each ``*_SQL`` text names the table it reads directly; in Spark it runs over a
view of that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.registry.core import table

USAGE_EVENTS_SQL = """
SELECT o_orderkey AS event_id, o_orderdate AS ts,
  CASE WHEN o_orderkey % 5 < 3 THEN 'ai' WHEN o_orderkey % 5 = 3 THEN 'image' ELSE 'search' END AS kind,
  CASE WHEN o_orderkey % 5 < 3 THEN CASE o_custkey % 4 WHEN 0 THEN 'glm-5.3' WHEN 1 THEN 'glm-5.2'
         WHEN 2 THEN 'mistral-small-3.2-24b-instruct-2506' ELSE 'unlisted-model' END
       WHEN o_orderkey % 5 = 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'ovh-sdxl' WHEN 1 THEN 'flux-pro-1.1' ELSE 'custom' END
       ELSE CASE o_custkey % 4 WHEN 0 THEN 'linkup' WHEN 1 THEN 'staan' WHEN 2 THEN 'searxng' ELSE 'unlisted' END END AS price_key,
  CASE WHEN o_orderkey % 5 < 3 THEN 'scaleway'
       WHEN o_orderkey % 5 = 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'ovh' WHEN 1 THEN 'bfl' ELSE 'custom' END
       ELSE CASE o_custkey % 4 WHEN 0 THEN 'linkup' WHEN 1 THEN 'staan' WHEN 2 THEN 'searxng' ELSE 'unlisted' END END AS provider,
  CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 10) AS BIGINT) ELSE 0 END AS input_tokens,
  CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) ELSE 0 END AS output_tokens,
  CASE WHEN o_orderkey % 5 >= 3 THEN CAST(o_orderkey % 3 AS BIGINT) ELSE 0 END AS units
FROM orders
"""

MESSAGES_MARKED_SQL = """
SELECT conv_id, turn, role,
 CASE WHEN role='assistant' AND turn % 4 = 1 THEN concat('<think>plan</think>', text, chr(10), '```python Demo ', cast(turn as varchar(10)), chr(10), 'x = ', cast(conv_id as varchar(10)), chr(10), '```', chr(10), 'done')
 WHEN role='assistant' AND conv_id % 5 = 0 THEN concat(text, chr(10), '```markdown', chr(10), 'quoted', chr(10), '```')
 WHEN role='assistant' AND conv_id % 5 = 1 THEN concat(text, chr(10), '```html Chart', chr(10), '<b>open')
 WHEN role='assistant' AND conv_id % 5 = 2 THEN concat(text, '<tool_call>{}') ELSE text END AS text
FROM conversations
"""


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a derivation over the given tables without leaving views behind."""
    names = {t: table(spark, sf_dir, t) for t in tables}
    # spark.sql formats {name} fields, so the only braces are the table fields
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **names)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, USAGE_EVENTS_SQL, "orders")


def messages_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MESSAGES_MARKED_SQL, "conversations")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, element): one row per text line, numbered from 1."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "element")
    ).select("doc_id", (F.col("pos") + 1).cast("long").alias("page_no"), "element")


DUCK_LINES = """
SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no,
       unnest(string_split(text, chr(10))) AS element FROM documents
"""
