"""Usage metering: price events, roll them up, report on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.plans.blocked import Scan, scan

CATEGORIES = ("ai", "image", "search")


def money(c: Column) -> Column:
    """Rounded past every digit a rate can produce, so that the order of a sum does not show."""
    return F.round(c, 8)


def raw_cost(rate: str) -> Column:
    """Cost in the rate's own currency."""
    r = F.col(rate)
    tokens = (F.col("input_tokens") / 1e6) * r["input_per_mtok"] + (F.col("output_tokens") / 1e6) * r["output_per_mtok"]
    return F.when(F.col("kind") == "ai", tokens).otherwise(F.col("units") * r["per_unit"])


def with_rate(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``rate``: the row for the event's price key, else its kind's ``default``."""
    fields = F.struct("input_per_mtok", "output_per_mtok", "per_unit", "currency")
    named = rates.select(F.col("kind").alias("r_kind"), F.col("name").alias("r_name"), fields.alias("r_rate"))
    default = rates.where("name = 'default'").select(F.col("kind").alias("d_kind"), fields.alias("d_rate"))
    return (
        events.join(
            named,
            (F.col("kind") == F.col("r_kind")) & (F.col("price_key") == F.col("r_name")),
            "left",
        )
        .join(default, F.col("kind") == F.col("d_kind"), "left")
        .withColumn("rate", F.coalesce("r_rate", "d_rate"))
        .drop("r_kind", "r_name", "r_rate", "d_kind", "d_rate")
    )


def to_display(df: DataFrame, fx: DataFrame, currency: str, display: str) -> DataFrame:
    """Add ``mult`` into the display currency: 1 for the currency itself and for one not listed."""
    side = fx.select(F.col("currency").alias("fx_currency"), F.col("mult").alias("fx_mult"))
    return (
        df.join(side, F.col(currency) == F.col("fx_currency"), "left")
        .withColumn("mult", F.when(F.col(currency) == display, F.lit(1.0)).otherwise(F.coalesce("fx_mult", F.lit(1.0))))
        .drop("fx_currency", "fx_mult")
    )


def priced(events: DataFrame, rates: DataFrame, fx: DataFrame, display: str = "EUR") -> DataFrame:
    """Add ``cost`` in the display currency; 0 where no rate applies."""
    rated = with_rate(events, rates).withColumn("__currency", F.col("rate.currency"))
    return (
        to_display(rated, fx, "__currency", display)
        .withColumn("cost", F.coalesce(raw_cost("rate") * F.col("mult"), F.lit(0.0)))
        .drop("rate", "mult", "__currency")
    )


def price_history(rates: DataFrame, versions: DataFrame) -> DataFrame:
    """Rates with the half-open period [valid_from, valid_to) of each version.

    ``rates`` has (version, kind, name, …), ``versions`` (version, collected).
    """
    w = Window.orderBy("collected")  # one row per published price list
    periods = versions.withColumn("valid_to", F.lead("collected").over(w)).withColumn(
        "first_version", F.row_number().over(w) == 1
    )
    return rates.join(periods.withColumnRenamed("collected", "valid_from"), "version")


def list_of_day(days: DataFrame, lists: DataFrame) -> DataFrame:
    """(day, list_version, before_first): the list in force on each day, carried forward along days and lists in one order.

    ``lists`` has (version, valid_from, valid_to). A day before every list takes
    the first one. Rows are days and lists, not events; they are scanned in
    blocks of a year or so.
    """
    held = F.struct("valid_from", "version", "valid_to")
    marks = lists.select(F.col("valid_from").cast("date").alias("day"), F.lit(0).alias("asked"), held.alias("list"))
    asked = days.select("day", F.lit(1).alias("asked"), F.lit(None).cast(marks.schema["list"].dataType).alias("list"))
    ordered = marks.unionByName(asked).withColumn("all", F.lit(0))
    found = scan(ordered, ["all"], ["day", "asked"], F.floor(F.unix_date("day") / 366), [
        Scan("last", "max", F.col("list")), Scan("first", "min", F.col("list"), "total"),
    ])
    early = F.col("last").isNull()
    chosen = F.when(early, F.col("first")).otherwise(F.col("last"))
    over = ~early & F.coalesce(F.col("day") >= chosen["valid_to"], F.lit(False))
    return found.where("asked = 1").select("day", F.when(~over, chosen["version"]).alias("list_version"), early.alias("before_first"))


def priced_as_of(events: DataFrame, history: DataFrame, fx: DataFrame, display: str = "EUR") -> DataFrame:
    """Price each event with the list collected last on or before its day.

    An event older than every list takes the first one and is flagged
    ``before_first``. The list is found once for each day; events then meet
    their day, their name's rate in that list and its default by equi-joins, so
    a popular name with a long history meets one version per event.
    """
    lists = history.select("version", "valid_from", "valid_to").distinct()
    day = F.to_date("ts")
    days = list_of_day(events.select(day.alias("day")).where("day IS NOT NULL").distinct(), lists)
    rated = history.select(
        F.col("version").alias("r_version"), F.col("kind").alias("r_kind"), F.col("name").alias("r_name"),
        F.struct("input_per_mtok", "output_per_mtok", "per_unit", "currency").alias("r_rate"),
    )
    default = rated.where("r_name = 'default'").select(
        F.col("r_version").alias("d_version"), F.col("r_kind").alias("d_kind"), F.col("r_rate").alias("d_rate")
    )
    joined = (
        events.withColumn("day", day).join(days, "day", "left")
        .join(rated, (F.col("list_version") == F.col("r_version")) & (F.col("kind") == F.col("r_kind")) & (F.col("price_key") == F.col("r_name")), "left")
        .join(default, (F.col("list_version") == F.col("d_version")) & (F.col("kind") == F.col("d_kind")), "left")
        .withColumn("rate", F.coalesce("r_rate", "d_rate"))
        .withColumn("version", F.when(F.col("rate").isNotNull(), F.col("list_version")))
        .withColumn("before_first", F.when(F.col("rate").isNotNull(), F.col("before_first")))
        .withColumn("__currency", F.col("rate.currency"))
    )
    return (
        to_display(joined, fx, "__currency", display)
        .withColumn("cost", F.coalesce(raw_cost("rate") * F.col("mult"), F.lit(0.0)))
        .select(*events.columns, "version", "before_first", "cost")
    )


def counted(events: DataFrame) -> DataFrame:
    """Drop events that count nothing."""
    return events.where(
        F.when(F.col("kind") == "ai", (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0)).otherwise(
            F.col("units") > 0
        )
    )


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_ledger(costed: DataFrame) -> DataFrame:
    """(month, category) totals."""
    kind = F.col("kind")
    return (
        counted(costed)
        .groupBy(month_of("ts").alias("month"), kind.alias("category"))
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(F.when(kind == "image", F.col("units")).otherwise(0)).alias("images"),
            F.sum(F.when(kind == "search", F.col("units")).otherwise(0)).alias("searches"),
            money(F.sum("cost")).alias("cost"),
        )
    )


def provider_tally(costed: DataFrame) -> DataFrame:
    """(month, category, provider) counts and cost of the unit-priced categories."""
    return (
        counted(costed)
        .where("kind <> 'ai'")
        .groupBy(month_of("ts").alias("month"), F.col("kind").alias("category"), "provider")
        .agg(F.sum("units").alias("count"), money(F.sum("cost")).alias("cost"))
    )


def all_time(costed: DataFrame) -> DataFrame:
    """Roll-up over months, categories and providers. The roll-up expands rows
    four times, so it runs on the monthly totals, not on the events."""
    monthly = (
        counted(costed)
        .groupBy(month_of("ts").alias("month"), F.col("kind").alias("category"), "provider")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("units").alias("units"),
            F.sum("cost").alias("cost"),
        )
    )
    return monthly.rollup("month", "category", "provider").agg(
        F.grouping_id().cast("long").alias("level"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("units").alias("units"),
        money(F.sum("cost")).alias("cost"),
    )


def summary(costed: DataFrame, month: str) -> DataFrame:
    """One row: this month and all time, per category and in total, in one pass."""
    now = month_of("ts") == month

    def total(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

    cols = []
    for period, in_period in (("month", now), ("all_time", F.lit(True))):
        for c in CATEGORIES:
            cols.append(money(total(F.col("cost"), in_period & (F.col("kind") == c))).alias(f"{period}_{c}_cost"))
        cols.append(money(total(F.col("cost"), in_period)).alias(f"{period}_cost"))
        cols.append(total(F.col("input_tokens") + F.col("output_tokens"), in_period).alias(f"{period}_tokens"))
        cols.append(total(F.col("units"), in_period).alias(f"{period}_units"))
    return counted(costed).agg(*cols)


def breakdown(tally: DataFrame, names: DataFrame) -> DataFrame:
    """``name n · name n`` per (month, category), in provider order; a provider
    without a display name is shown by its key, one without usage not at all."""
    return (
        tally.where("count > 0")
        .join(names, ["category", "provider"], "left")
        .withColumn("part", F.concat_ws(" ", F.coalesce("name", "provider"), F.col("count").cast("string")))
        .groupBy("month", "category")
        .agg(F.expr("listagg(part, ' · ') WITHIN GROUP (ORDER BY provider)").alias("line"))
    )


def migrate_ledgers(current: DataFrame, legacy: DataFrame, merged: DataFrame) -> DataFrame:
    """Fold legacy ledgers into the current one, leaving out sources already
    merged, so that running it again changes nothing.

    ``current`` and ``legacy`` have (month, category, units, cost); ``legacy``
    and ``merged`` carry ``source_id``.
    """
    fresh = legacy.join(merged.select("source_id").distinct(), "source_id", "left_anti")
    return (
        current.select("month", "category", "units", "cost")
        .unionByName(fresh.select("month", "category", "units", "cost"))
        .groupBy("month", "category")
        .agg(F.sum("units").alias("units"), money(F.sum("cost")).alias("cost"))
    )
