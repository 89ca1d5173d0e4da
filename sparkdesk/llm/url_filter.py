"""URL filtering by fixed rules, and by association rules mined from labelled URLs.

A labelled URL is a basket: the tokens of its host and path, and its label.
Spark's FP-growth finds the frequent baskets. Token combinations that predict
the label ``block`` with enough support and confidence become rules, and one
that a shorter rule implies with no less confidence is pruned. Rules are matched
through an inverted index: each rule is filed under its rarest token, a URL's
tokens look up their rules, and a rule holds if all of its tokens are there.

Rules are mined from ``SAMPLE`` labelled rows at most (those of the smallest
hashed ids); every page is judged. Pruning runs on Spark before anything is
chosen, and every rule it leaves is kept: the index is a table of its own, whose
written size tells Spark whether it may be broadcast.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows are judged each; an empty table gives
no rows; columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from sparkdesk.llm.common import stage

SAMPLE = 50_000
LONGEST_RULE = 3  # tokens in a rule
SUPPORT = 0.002
CONFIDENCE = 0.5
LABEL = "label:block"

#: verdict, host and its subdomains, start of the path
LIST = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LIST) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: each label of the host, each domain above it, each part of the path and its shape."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, -k, k), "."))))
    parts = F.filter(F.split(F.lower(path), r"[/\-_.=&]+"), lambda x: x != "")
    shaped = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    digits = F.transform(
        F.filter(parts, lambda x: x.rlike(r"\A[0-9]+\z")),
        lambda x: F.concat(F.lit("n:"), F.length(x).cast("string"), F.lit(":"), F.substring(x, 1, 1)),
    )
    depth = F.array(F.concat(F.lit("depth:"), F.size(parts).cast("string")))
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.coalesce(above, none), shaped, digits, depth)
    )


_RULES = "token string, needed array<string>, confidence double, blocked long"


def mine_rules(baskets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """token (the rarest one needed), needed, confidence, blocked of each rule; ``baskets`` has items and blocked."""
    rows = baskets.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items"))
    if rows.isEmpty():
        return baskets.sparkSession.createDataFrame([], _RULES)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    short = model.freqItemsets.where(F.size("items") <= LONGEST_RULE + 1)
    sets = stage(
        short.select(F.array_sort(F.array_remove("items", LABEL)).alias("key"), F.array_contains("items", LABEL).alias("labelled"), "freq"),
        "url-itemsets",
    )
    with_label = sets.where(F.col("labelled") & (F.size("key") > 0)).select("key", F.col("freq").alias("blocked"))
    alone = sets.where(~F.col("labelled")).select("key", "freq")
    found = (
        with_label.join(alone, "key").withColumn("confidence", F.col("blocked") / F.col("freq"))
        .where(F.col("confidence") >= confidence).select("key", "confidence", "blocked")
    )
    # a shorter rule that a frequent one contains is frequent too, so each is met by its key
    inside = F.expr("transform(sequence(1, (1 << size(key)) - 2), m -> filter(key, (x, i) -> shiftright(m, i) % 2 = 1))")
    parts = found.where(F.size("key") > 1).select("key", "confidence", F.explode(inside).alias("part"))
    shorter = found.select(F.col("key").alias("part"), F.col("confidence").alias("own"))
    implied = parts.join(shorter, "part").where("own >= confidence").select("key")
    kept = found.join(implied, "key", "left_anti")
    single = alone.where(F.size("key") == 1).select(F.col("key")[0].alias("token"), "freq")
    filed = kept.select("*", F.explode("key").alias("token")).join(single, "token").groupBy("key", "confidence", "blocked")
    filed = filed.agg(F.min(F.struct("freq", "token")).alias("rarest"))
    return stage(filed.select("rarest.token", F.col("key").alias("needed"), "confidence", "blocked"), "url-rules")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, confidence, matched): the most confident rule of each row that has one; ``pages`` has row and items."""
    looked = pages.select("row", "items", F.explode("items").alias("token"))
    holds = (looked["token"] == rules["token"]) & (F.size(F.array_except(rules["needed"], looked["items"])) == 0)
    return (
        looked.join(rules, holds).groupBy("row").agg(F.max(F.struct("confidence", "needed")).alias("m"))
        .select("row", F.col("m.confidence").alias("confidence"), F.col("m.needed").alias("matched"))
    )


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, matched; ``labels`` has page_id and blocked."""
    host, path = host_and_path()
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("items", F.when(F.col("host") != "", tokens(F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    chosen = (
        labels.where("page_id IS NOT NULL AND blocked IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
        .orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    )
    baskets = parsed.where(F.size("items") > 0).join(F.broadcast(chosen), "page_id").select("items", "blocked")
    rules = mine_rules(baskets)
    # judged once per distinct URL, so rows need no key of their own
    urls = parsed.where(F.size("items") > 0).select(F.struct("host", "path").alias("row"), "items").dropDuplicates(["row"])
    matched = match_rules(urls, rules).select(F.col("row.host").alias("host"), F.col("row.path").alias("path"), "confidence", "matched")
    rule, verdict = listed(F.col("host"), F.col("path"))
    out = parsed.withColumn("rule", rule).withColumn("listed", verdict).join(matched, ["host", "path"], "left")
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), "confidence", "matched")
