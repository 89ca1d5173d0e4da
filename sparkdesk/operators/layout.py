"""Recognised text fragments of a page, put into reading order.

Fragments are (page_id, min_y, max_y, min_x, max_x, text), the origin being at
the bottom left. A page's text ends as one value, which bounds what is gathered
per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.functions.text import trimmed

GUTTER_MIN_WIDTH = 0.12
GUTTER_MIN_ROWS = 3
TOLERANCE = GUTTER_MIN_WIDTH / 2
MANY_COLUMNS = "it is laid out in more than one column, which this app cannot read in the right order yet"


def line_pieces(fragments: DataFrame) -> DataFrame:
    """Lines with the fragments on them: (page_id, cluster, row, items), an item
    being (top_down, min_x, min_y, text, max_x, max_y) in the order of the fold.

    A fragment joins the line above it when they overlap by more than half the
    shorter of the two, and the line grows with it, so lines are a fold from
    the top down. A fragment that lies below everything before it can join
    nothing: there the page is cut into clusters (a running minimum finds the
    cuts), and the fold runs in each cluster on its own. While a cluster is one
    line, that line's top is its first fragment's and its bottom the running
    minimum, so windows see whether all of it joins, and only other clusters
    are folded. A line is a run of items, because a line once left is closed.
    Everything is per page, and shares one shuffle and one sort of the fragments.
    """
    w = Window.partitionBy("page_id").orderBy(F.desc("max_y"), F.asc("min_x"), F.asc("min_y"), F.asc("text"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = F.min("min_y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.col("lowest").isNull() | (F.col("max_y") <= F.col("lowest"))
    clustered = fragments.withColumn("lowest", lowest).withColumn("cut", cut).withColumns({
        "cluster": F.count_if("cut").over(upto), "top": F.last(F.when(F.col("cut"), F.col("max_y")), ignorenulls=True).over(upto),
    })

    def joins(top: Column, bottom: Column, max_y: Column, min_y: Column) -> Column:
        overlap = F.least(top, max_y) - F.greatest(bottom, min_y)
        return overlap > 0.5 * F.least(top - bottom, max_y - min_y)

    alone = F.col("cut") | joins(F.col("top"), F.col("lowest"), F.col("max_y"), F.col("min_y"))
    item = F.struct((-F.col("max_y")).alias("top_down"), "min_x", "min_y", "text", "max_x", "max_y")
    grouped = clustered.groupBy("page_id", "cluster").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.bool_and(F.coalesce(alone, F.lit(False))).alias("whole")
    )
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"), F.array().cast("array<int>").alias("starts")
    )

    def step(acc: Column, f: Column) -> Column:
        joined = (acc["n"] > 0) & joins(acc["top"], acc["bottom"], f["max_y"], f["min_y"])
        return F.struct(
            (acc["n"] + 1).alias("n"),
            F.when(joined, F.greatest(acc["top"], f["max_y"])).otherwise(f["max_y"]).alias("top"),
            F.when(joined, F.least(acc["bottom"], f["min_y"])).otherwise(f["min_y"]).alias("bottom"),
            F.when(joined, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["n"] + 1))).alias("starts"),
        )

    # where lines start, from 1; the bound variable keeps the fold from being computed for each line
    folded = F.flatten(F.transform(
        F.array(F.aggregate("items", start, step, lambda acc: acc["starts"])),
        lambda starts: F.transform(starts, lambda at, i: F.struct(
            i.alias("row"), F.slice("items", at, F.coalesce(F.get(starts, i + 1), F.size("items") + 1) - at).alias("items"))),
    ))
    lines = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("row"), F.col("items")))).otherwise(folded)
    return grouped.select("page_id", "cluster", F.inline(lines))


def text_lines(pieces: DataFrame) -> DataFrame:
    """One row per line: (page_id, cluster, row, text, gaps), its pieces from
    left to right; ``gaps`` are the middles of the wide spaces between them."""
    across = F.sort_array(F.transform("items", lambda x, i: F.struct(
        x["min_x"].alias("min_x"), i.alias("pos"), x["max_x"].alias("max_x"), x["text"].alias("text"))))
    gaps = F.filter(
        F.transform(
            F.sequence(F.lit(2), F.size("items")),
            lambda i: F.struct(
                F.get("items", i - 2)["max_x"].alias("left"),
                (F.get("items", i - 1)["min_x"] - F.get("items", i - 2)["max_x"]).alias("gap"),
            ),
        ),
        lambda g: g["gap"] >= GUTTER_MIN_WIDTH,
    )
    words = F.filter(F.transform("items", lambda x: trimmed(x["text"])), lambda t: t != "")
    # out of a generator, so that what reads the sorted pieces does not sort them again
    return pieces.select("page_id", "cluster", "row", F.explode(F.array(across)).alias("items")).select(
        "page_id", "cluster", "row", F.array_join(words, " ").alias("text"),
        F.when(F.size("items") > 1, F.transform(gaps, lambda g: g["left"] + g["gap"] / 2))
        .otherwise(F.array().cast("array<double>")).alias("gaps"),
    )


def gutters(gaps: DataFrame, tolerance: float = TOLERANCE, at_least: int = GUTTER_MIN_ROWS) -> DataFrame:
    """(page_id, gap) of gaps (page_id, gap) that enough others line up with.

    Equal positions are counted once, before anything moves. Positions are then
    placed in bands one tolerance wide, each also sent to its two neighbours,
    and counted with a range window per band: no pairs are formed.
    """
    counted = gaps.groupBy("page_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    home = F.floor(F.col("gap") / tolerance).cast("long")
    spread = counted.withColumn("home", home).select("*", F.explode(F.array(*[F.col("home") + d for d in (-1, 0, 1)])).alias("band"))
    near = F.expr(
        f"sum(n) OVER (PARTITION BY page_id, band ORDER BY gap RANGE BETWEEN {tolerance}D PRECEDING AND {tolerance}D FOLLOWING)"
    )
    return (
        spread.withColumn("aligned", near)
        .where((F.col("band") == F.col("home")) & (F.col("aligned") >= at_least))
        .select("page_id", "gap", "aligned")
    )


def reading_order(fragments: DataFrame) -> DataFrame:
    """(page_id, text, error): the page's lines from the top down; a page in
    columns is refused, because it would be read across instead of down.

    Three gaps line up with one of them just when three neighbours among the
    sorted gaps are each within the tolerance of the next.
    """
    said = F.when(F.col("text") != "", F.struct("cluster", "row", "text"))
    pages = text_lines(line_pieces(fragments)).groupBy("page_id").agg(
        F.sort_array(F.collect_list(said)).alias("lines"), F.sort_array(F.flatten(F.collect_list("gaps"))).alias("gaps")
    )
    close = lambda i: F.get("gaps", i) - F.get("gaps", i - 1) <= TOLERANCE
    columns = (F.size("gaps") >= GUTTER_MIN_ROWS) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("gaps") - 2)), lambda i: close(i) & close(i + 1)
    )
    return pages.select("page_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), columns.alias("columns")).select(
        "page_id", F.when(~F.col("columns"), F.col("text")).alias("text"), F.when(F.col("columns"), MANY_COLUMNS).alias("error")
    )
