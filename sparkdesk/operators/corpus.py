"""Corpora and the protocol of the readers run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparkdesk.functions.text import is_readable

MAX_INPUT_BYTES = 20 * 1024 * 1024
MAGIC_WITHIN = 1024


def manifest_problems(documents: DataFrame, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """(rule, id) for manifest rows (…, ``content``) that break a rule. Repeats
    are found by counting per id and per hash, so many copies are one row each."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    hash_form = F.coalesce(F.col("sha256").rlike("^[a-f0-9]{64}$"), F.lit(False))
    small = F.octet_length("content") <= max_bytes
    magic = F.contains(F.substring("content", 1, MAGIC_WITHIN), F.lit(b"%PDF-"))
    row_rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("id").rlike("^[a-zA-Z0-9_-]+$"), F.lit(False)), "invalid id"),
        F.when(blank("source") | blank("category") | blank("provenance"), "missing field"),
        F.when(~hash_form, "bad hash form"),
        F.when(~small, "too large"),
        F.when(small & ~magic, "not a PDF"),
        F.when(small & hash_form & (F.sha2("content", 256) != F.col("sha256")), "hash mismatch"),
    ))
    single = documents.select(F.explode(row_rules).alias("rule"), "id")
    ids = documents.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), "id")
    copies = documents.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    return single.unionByName(ids).unionByName(copies.select(F.lit("repeated bytes").alias("rule"), "id"))


READERS = ["current", "pdfkit"]


def record_states(parsed: DataFrame) -> DataFrame:
    """Every record of a run with its ``error``, null when it is accepted.

    A run ends at its first end record that names two readers and follows a
    record of each; anything after it is out of place. Only the first record
    of a reader counts. The places that decide this are minima per run, in
    windows without an order, so records are parsed once and share one shuffle;
    whether a record has ``readable`` text is settled before it, so that pages
    move only if the caller wants them.
    """
    r = F.col("r")
    valid = (
        r["reader"].isin(READERS) & (F.coalesce(r["elapsedMs"], F.lit(-1.0)) >= 0) & r["result"].isNotNull()
    )
    typed = parsed.withColumn(
        "type",
        F.when(F.col("problem").isNotNull(), "bad").when(r["record"] == "end", "end")
        .when((r["record"] == "reader") & F.coalesce(valid, F.lit(False)), "reader")
        .when(r["record"] == "reader", "invalid").otherwise("unknown"),
    )
    run = Window.partitionBy("run_id")
    first = lambda name: F.min(F.when((F.col("type") == "reader") & (F.col("reader") == name), F.col("seq"))).over(run)
    readable = F.exists(F.coalesce(r["result"]["pages"], F.array().cast("array<string>")), is_readable)
    placed = typed.where("run_id IS NOT NULL").select(
        "run_id", "seq", "type", "problem", r["reader"].alias("reader"), r["readers"].alias("readers"),
        r["result"]["pages"].alias("pages"), readable.alias("readable"),
    ).withColumns({"first_current": first("current"), "first_pdfkit": first("pdfkit")})
    ends = (F.col("type") == "end") & (F.col("readers") == 2) & (F.col("first_current") < F.col("seq")) & (
        F.col("first_pdfkit") < F.col("seq"))
    ended = placed.withColumn("end_seq", F.min(F.when(ends, F.col("seq"))).over(run))
    own_first = F.when(F.col("reader") == "current", F.col("first_current")).otherwise(F.col("first_pdfkit"))
    error = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("seq") > F.col("end_seq"), "after the end")
        .when((F.col("type") == "end") & ~F.coalesce(ends, F.lit(False)), "end too early")
        .when(F.col("type") == "invalid", "invalid reader")
        .when((F.col("type") == "reader") & (F.col("seq") > own_first), "reader repeated")
        .when(
            (F.col("type") == "reader") & (F.col("reader") == "pdfkit")
            & (F.col("first_current").isNull() | (F.col("first_current") > F.col("seq"))),
            "optional reader first",
        )
        .when(F.col("type") == "unknown", "unknown record")
    )
    return ended.select(
        "run_id", "seq", "type", "reader", "pages", "readable", error.alias("error"),
        (F.col("seq") == F.col("end_seq")).alias("is_end"),
        ((F.col("type") == "reader") & (F.col("seq") == own_first)
         & (F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq")))).alias("accepted"),
    )


def comparison_classes(states: DataFrame, processes: DataFrame) -> DataFrame:
    """(run_id, class, readers): ``success`` needs a clean process and protocol
    and both readers; otherwise some readable text makes it ``partial``."""
    ok = F.coalesce("accepted", F.lit(False))
    runs = states.groupBy("run_id").agg(
        F.count_if(ok).alias("readers"),
        F.bool_or(F.coalesce("is_end", F.lit(False))).alias("ended"),
        F.bool_and(F.col("error").isNull()).alias("clean"),
        F.bool_or(ok & F.col("readable")).alias("readable"),
    )
    finished = (
        (F.coalesce("status", F.lit(-1)) == 0) & F.col("signal").isNull() & F.col("reason").isNull()
        & F.coalesce("exit_confirmed", F.lit(False))
    )
    seen = lambda c: F.coalesce(c, F.lit(False))
    return processes.join(runs, "run_id", "left").select(
        "run_id",
        F.when(finished & seen("ended") & seen("clean") & (F.col("readers") == 2), "success")
        .when(seen("readable"), "partial").otherwise("failed").alias("class"),
        F.coalesce("readers", F.lit(0).cast("long")).alias("readers"),
    )
