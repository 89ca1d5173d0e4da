"""Captured reply streams: decode the lines, assemble the replies.

Lines are (request_id, seq, line). One request may hold a large share of all
lines, so everything ordered goes through the block scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkdesk.functions.text import trimmed
from sparkdesk.plans.blocked import BLOCK, Scan, block_of, scan

MAX_LINE_BYTES = 1024 * 1024
MAX_REPLY_BYTES = 8 * 1024 * 1024

_EVENT = (
    "struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>,"
    "choices:array<struct<finish_reason:string,delta:struct<content:variant,reasoning_content:variant>>>>"
)


def _marked(lines: DataFrame, max_line_bytes: int) -> DataFrame:
    """(request_id, seq, data, oversized, done) of the lines that can matter."""
    body = trimmed(F.col("line"))
    oversized = F.octet_length("line") > max_line_bytes
    data = F.when(~oversized & body.startswith("data:"), trimmed(F.substr(body, F.lit(6))))
    return lines.select("request_id", "seq", data.alias("data"), oversized.alias("oversized")).where(
        "data IS NOT NULL OR oversized"
    ).withColumn("done", F.coalesce(F.col("data") == "[DONE]", F.lit(False)))


def line_events(v: Column, oversized: Column, first_thinking: Column) -> Column:
    """The events of one line, in order; ``v`` is its parsed JSON."""

    def event(kind: str, token=None, prompt=None, completion=None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if token is None else token).alias("token"),
            (F.lit(None).cast("long") if prompt is None else prompt).alias("prompt"),
            (F.lit(None).cast("long") if completion is None else completion).alias("completion"),
        )

    u, first = v["usage"], F.get(v["choices"], F.lit(0))
    zero = F.lit(0).cast("long")
    prompt, completion, total = (F.when(u[n] >= 0, u[n]) for n in ("prompt_tokens", "completion_tokens", "total_tokens"))
    both = prompt.isNotNull() & completion.isNotNull()
    rest = F.greatest(zero, total - F.coalesce(prompt, zero))
    token = _delta(v, "content")
    return F.array_compact(F.array(
        F.when(oversized, event("error")),
        F.when(both | total.isNotNull(), event("usage", None, F.coalesce(prompt, zero), F.when(both, completion).otherwise(rest))),
        F.when(first["finish_reason"] == "length", event("truncated")),
        F.when(token != "", event("token", token)),
        F.when(first_thinking, event("thinking")),
    ))


def decode(
    lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES, block_size: int = BLOCK, count_bytes: bool = False
) -> DataFrame:
    """(request_id, seq, pos, kind, token, prompt, completion).

    A request ends at its first ``[DONE]`` or oversized line; the latter is an
    error. Lines that are not data, or not JSON, give nothing. With
    ``count_bytes`` each event also has the reply's ``bytes`` up to it: lines
    after the end cannot change a sum over the lines before it, so one scan
    serves both.
    """
    marked = _marked(lines, max_line_bytes)
    if count_bytes:
        marked = marked.withColumn("v", F.from_json("data", _EVENT)).drop("data")
        v = F.col("v")
    else:
        # only lines that mention it are parsed before the scan
        v = F.from_json(F.when(F.contains("data", F.lit('"reasoning_content"')), F.col("data")), _EVENT)
    thinking = F.when(_delta(v, "reasoning_content") != "", 1)
    scans = [
        Scan("stops", "count", F.when(F.col("done") | F.col("oversized"), 1), "before"),
        Scan("thoughts", "count", thinking, "upto"),
        Scan("earlier_thoughts", "count", thinking, "before"),
    ]
    size = F.coalesce(F.octet_length(_delta(F.col("v"), "content")), F.lit(0)).cast("long")
    if count_bytes:
        scans.append(Scan("bytes", "sum", size, "upto"))
    placed = scan(marked, ["request_id"], ["seq"], block_of(F.col("seq"), block_size), scans)
    if count_bytes:
        # usage and truncation come before the token of their own line
        extra = [F.when(F.col("e.kind").isin("token", "thinking"), F.col("bytes")).otherwise(F.col("bytes") - F.col("size")).alias("bytes")]
        carried = ["bytes", size.alias("size")]
    else:
        placed, extra, carried = placed.withColumn("v", F.from_json("data", _EVENT)), [], []
    first_thinking = (F.col("thoughts") == 1) & (F.col("earlier_thoughts") == 0)
    return (
        placed.where((F.col("stops") == 0) & ~F.col("done"))
        .select("request_id", "seq", *carried, F.posexplode(line_events(F.col("v"), F.col("oversized"), first_thinking)).alias("pos", "e"))
        .select("request_id", "seq", "pos", "e.*", *extra)
    )


def _delta(v: Column, field: str) -> Column:
    """A field of the first choice, if it is a string; anything else says nothing."""
    value = F.get(v["choices"], F.lit(0))["delta"][field]
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def assemble(
    lines: DataFrame, max_bytes: int = MAX_REPLY_BYTES, max_line_bytes: int = MAX_LINE_BYTES, block_size: int = BLOCK
) -> DataFrame:
    """One row per request: (request_id, reply, truncated, failed, prompt, completion).

    The first token that would pass ``max_bytes`` ends the reply, keeping what
    came before it, so a row gathers that many bytes at most. A failed request
    has no reply.
    """
    events = decode(lines, max_line_bytes, block_size, count_bytes=True).withColumn("kept", F.col("bytes") <= max_bytes)
    usage = F.when(F.col("kept") & (F.col("kind") == "usage"), F.struct("seq", "prompt", "completion"))
    return (
        events.withColumn("token", F.when(F.col("kept"), F.col("token")))
        .groupBy("request_id")
        .agg(
            F.expr("listagg(token, '') WITHIN GROUP (ORDER BY seq)").alias("reply"),
            F.bool_or(~F.col("kept") | (F.col("kind") == "truncated")).alias("truncated"),
            F.bool_or((F.col("kind") == "error") & F.col("kept")).alias("failed"),
            F.max(usage).alias("usage"),
        )
        .select(
            "request_id",
            F.when(~F.col("failed"), F.coalesce("reply", F.lit(""))).alias("reply"),
            "truncated", "failed", "usage.prompt", "usage.completion",
        )
    )
