"""Grading a prompt-suite run.

Results are (id, category, text, error, ms, inputTokens, outputTokens, cost);
cases (id, assert, review, appLevel).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkdesk.functions.grading import checks, compiles, verdict
from sparkdesk.plans.blocked import order_statistic

VERDICTS = ["PASS", "FAIL", "REVIEW", "ERROR"]


def graded(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results with their case, ``checks`` and ``verdict``; a result without a
    case is kept, with nothing to check. Each different pattern is compiled once,
    apart from the texts; one that is broken fails its own cases."""
    patterns = cases.select(F.col("assert.regex").alias("pattern")).where("pattern <> ''").distinct()
    broken = patterns.where(~compiles(F.col("pattern"))).withColumn("broken", F.lit(True))
    spec = cases.select("id", F.col("assert").alias("asserts"), "review", F.coalesce("appLevel", F.lit(False)).alias("app_level"))
    spec = spec.join(broken, F.col("asserts.regex") == F.col("pattern"), "left").drop("pattern")
    joined = results.join(spec, "id", "left")
    none = F.array().cast("array<struct<name:string,ok:boolean,detail:string,heuristic:boolean>>")
    run = F.when(
        (F.coalesce("error", F.lit("")) == "") & F.col("asserts").isNotNull(),
        checks(F.col("asserts"), F.coalesce("text", F.lit("")), F.coalesce("broken", F.lit(False))),
    )
    return (
        joined.withColumn("checks", F.coalesce(run, none))
        .withColumn("verdict", verdict(F.col("error"), F.col("asserts"), F.col("checks")))
        .withColumn("app_level", F.coalesce("app_level", F.lit(False)))
        .drop("broken")
    )


def check_rows(graded_results: DataFrame) -> DataFrame:
    return graded_results.select("id", F.inline("checks"))


def run_summary(graded_results: DataFrame, bucket_ms: float = 64.0) -> DataFrame:
    """One row per ``run``: requests, verdict counts, total cost, and the
    middle (not interpolated) and slowest latency."""
    totals = graded_results.groupBy("run").agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS],
        F.round(F.sum("cost"), 6).alias("cost"),
    )
    median = order_statistic(graded_results, ["run"], "ms", F.floor(F.col("n") / 2), bucket_ms, "median_ms")
    return totals.join(median.select("run", F.col("largest").alias("slowest_ms"), "median_ms"), "run", "left")


def report_rows(graded_results: DataFrame) -> DataFrame:
    """Per case: what failed, and what a person still has to read."""
    failed = F.filter("checks", lambda c: ~c["ok"])
    listed = F.array_join(F.transform(failed, lambda c: F.concat_ws(" — ", c["name"], c["detail"])), "; ")
    heuristic = F.array_join(
        F.transform(
            F.filter("checks", lambda c: c["heuristic"]),
            lambda c: F.concat(c["name"], F.lit(": "), F.when(c["ok"], "as expected").otherwise("MISMATCH")),
        ), ", ")
    return graded_results.select(
        "id", "verdict",
        F.when(F.coalesce("error", F.lit("")) != "", F.left(F.col("error"), F.lit(80))).otherwise(listed).alias("failed"),
        F.col("review").alias("needs_review"), heuristic.alias("heuristic"),
    )


def hotspots(results: DataFrame, n: int = 5) -> DataFrame:
    return results.select("id", F.coalesce("cost", F.lit(0.0)).alias("cost"), "inputTokens", "outputTokens").orderBy(
        F.desc("cost"), "id"
    ).limit(n)


def spec_problems(turns: DataFrame) -> DataFrame:
    """(rule, id) for cases without an id or prompt, repeated ids, and cases
    that neither a machine nor a person would judge."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    single = turns.select(
        "id",
        F.explode(F.array_compact(F.array(
            F.when(blank("id"), "no id"),
            F.when(F.col("prompt").isNull() & F.col("promptGenerator").isNull(), "no prompt"),
            F.when(F.col("assert").isNull() & blank("review"), "nothing judges it"),
        ))).alias("rule"),
    ).select("rule", "id")
    repeated = turns.where(~blank("id")).groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), "id")
    return single.unionByName(repeated)
