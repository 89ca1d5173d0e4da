"""Reply logs derived from the assistant turns of stored conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.registry.core import table


def reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, seq, line): a word per data line, then usage and the end mark.

    Every 3rd request thinks first, every 8th has a malformed line, every 9th
    stops for length, every 5th goes on after its end.
    """
    r = F.col("conv_id") * 1000 + F.col("turn")
    words = F.split("text", " ")

    def content(w):
        return F.concat(F.lit('data: {"choices":[{"delta":'), F.to_json(F.struct(w.alias("content"))), F.lit("}]}"))

    def only(cond, *lines):
        return F.when(cond, F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])).otherwise(
            F.array().cast("array<string>")
        )

    thought = 'data: {"choices":[{"delta":{"reasoning_content":"hm"}}]}'
    usage = F.concat(
        F.lit('data: {"choices":[],"usage":{"prompt_tokens":'), F.col("turn").cast("string"),
        F.lit(',"completion_tokens":'), F.size(words).cast("string"), F.lit("}}"),
    )
    lines = F.concat(
        F.array(F.lit(": keep-alive")),
        only(r % 3 == 0, thought, thought),
        only(r % 8 == 0, "data: {bad"),
        F.transform(words, lambda w, i: content(F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))),
        only(r % 9 == 0, 'data: {"choices":[{"finish_reason":"length","delta":{}}]}'),
        F.array(usage, F.lit("data: [DONE]")),
        only(r % 5 == 0, 'data: {"choices":[{"delta":{"content":"late"}}]}'),
    )
    return (
        table(spark, sf_dir, "conversations").where("role = 'assistant'")
        .select(r.alias("request_id"), F.posexplode(lines).alias("seq", "line"))
        .withColumn("seq", F.col("seq").cast("long"))
    )


DUCK_TOKENS = """w AS (SELECT conv_id * 1000 + turn AS r, turn, string_split(text, ' ') AS ws FROM conversations WHERE role = 'assistant'),
base AS (SELECT *, 1 + CASE WHEN r % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN r % 8 = 0 THEN 1 ELSE 0 END AS start FROM w),
tok AS (SELECT r, start + i - 1 AS seq, CASE WHEN i = 1 THEN ws[i] ELSE ' ' || ws[i] END AS token FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM base)),
ev AS (
 SELECT r AS request_id, seq, 'token' AS kind, token, NULL::BIGINT AS prompt, NULL::BIGINT AS completion FROM tok WHERE token <> ''
 UNION ALL SELECT r, 1, 'thinking', NULL, NULL, NULL FROM base WHERE r % 3 = 0
 UNION ALL SELECT r, start + len(ws), 'truncated', NULL, NULL, NULL FROM base WHERE r % 9 = 0
 UNION ALL SELECT r, start + len(ws) + CASE WHEN r % 9 = 0 THEN 1 ELSE 0 END, 'usage', NULL, turn, len(ws) FROM base)"""
