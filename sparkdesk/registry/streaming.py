"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.operators.usage import priced
from sparkdesk.plans.derive import USAGE_EVENTS_SQL
from sparkdesk.plans.reply_lines import reply_lines
from sparkdesk.registry.conversations import _CALLS
from sparkdesk.registry.core import query, table
from sparkdesk.registry.replies import DUCK_REPLIES
from sparkdesk.registry.usage import _PRICED
from sparkdesk.session import new_path
from sparkdesk.sources.prices import current_price_list
from sparkdesk.streaming import calls as SC, ledger as SL, replies as SR


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _ledger(spark, sf_dir):
    events = spark.sql(USAGE_EVENTS_SQL.replace("FROM orders", "FROM {orders}"), orders=stream(spark, sf_dir, "orders"))
    rates, fx = current_price_list(spark)
    return SL.running_ledger(priced(events, rates, fx))


_LEDGER = _PRICED + """SELECT month, kind AS category, provider, CAST(sum(units) AS BIGINT) AS count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 8) AS cost FROM counted GROUP BY ALL"""


@query("streaming_ledger_t3", _LEDGER)
def streaming_ledger(spark, sf_dir):
    path = new_path(spark, "ledger")
    SL.start_ledger(_ledger(spark, sf_dir), path, new_path(spark, "ledger-checkpoint")).awaitTermination()
    return SL.read_ledger(spark, path)


@query("retried_ledger_t5", _LEDGER)
def retried_ledger(spark, sf_dir):
    """The same in several batches, each written twice, as after a write whose success was not recorded, and folded in twos."""
    path = new_path(spark, "ledger")
    write = SL.write_batch(path, compact_every=2)

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    SL.start_ledger(_ledger(spark, sf_dir), path, new_path(spark, "ledger-checkpoint"), sink=twice).awaitTermination()
    return SL.read_ledger(spark, path)


@query("streaming_calls_t4", f"SELECT DISTINCT turn_id, tool, arguments FROM ({_CALLS})")
def streaming_calls(spark, sf_dir):
    events = spark.sql(_CALLS.replace("FROM events", "FROM {events}").replace("SELECT", "SELECT CAST(ts AS TIMESTAMP) AS ts,", 1),
                       events=stream(spark, sf_dir, "events"))
    path = new_path(spark, "calls")
    (
        SC.distinct_calls(events, "60 days").select("turn_id", "tool", "arguments").writeStream.format("parquet")
        .option("checkpointLocation", new_path(spark, "calls-checkpoint")).option("path", path)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema("turn_id long, tool string, arguments string").parquet(path)


_CAP = 400


@query("streaming_replies_t2", DUCK_REPLIES.replace("{cap}", str(_CAP)))
def streaming_replies(spark, sf_dir):
    """Reply lines written in two parts, the later lines first, and streamed a few files at a time.

    Every 7th request has lost its first line and never gets an end mark.
    """
    source = new_path(spark, "reply-lines")
    lost = (F.col("request_id") % 7 == 0) & ((F.col("seq") == 0) | F.col("line").contains("[DONE]") | F.col("line").contains('"late"'))
    lines = reply_lines(spark, sf_dir).where(~lost)
    lines.where("seq >= 20").write.mode("append").parquet(source)
    lines.where("seq < 20").write.mode("append").parquet(source)
    path = new_path(spark, "replies")
    incoming = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(source)
    SR.start_replies(SR.assembled(incoming, max_bytes=_CAP), path, new_path(spark, "replies-checkpoint")).awaitTermination()
    emitted = spark.read.schema(SR.REPLY_COLUMNS).parquet(path)
    return emitted.unionByName(SR.open_requests(spark.read.schema(lines.schema).parquet(source), emitted, max_bytes=_CAP))
