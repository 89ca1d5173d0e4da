"""Mixing sources to target weights by a tree of budgets, in DataFrame operations alone.

Weights are shares at each node of a domain - language - source tree. A leaf can
give its tokens ``epochs`` times; a node what its children can. Budgets go from
the root down: the children of a node share its budget by weight, a child that
cannot use its share gives the rest to its siblings, and only what no sibling
can use was never given to the node, so it goes to the ancestors' other
branches. With children ordered by capacity over weight this is one running sum.

A leaf reads its documents epoch after epoch, each in an order seeded by the
epoch, until its budget of tokens is full; the last document is cut there. The
running sum is taken over buckets of that order first, then inside each bucket.
A leaf has as many buckets as a bucket has rows, so that of a leaf with a third
of all rows no task meets more than the square root. An id on a third of all rows
is spread by the rest of its row, and rows alike are one row with a count.

Defined results: null domains, languages and sources are values of their own;
null weights count as 1, weights of 0 or less give nothing; a null or empty text
has no tokens and costs nothing: where no weight is 0 or less it is taken with the
first epoch whatever the budget, and again with every whole epoch; rows alike in
all columns named are counted first and stand side by side in the order, each a
row of its own; an empty table gives no rows; other columns are kept only if named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.llm.common import join_alike, stage

EPOCHS = 4
SEED = 17


def token_count(text: str = "text") -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def share(children: DataFrame, parents: Sequence[str], child: Sequence[str], budget: str, out: str) -> DataFrame:
    """Water-filling: each parent's ``budget`` over its children's ``weight``, none above its ``capacity``.

    Whole tokens; what rounding leaves goes to the largest remainders that still have room.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parents).orderBy("__ratio", *child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parents)
    filled = F.col("__ratio") * F.col("__rest") <= F.col(budget) - F.col("__full")
    df = (
        children.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))
        .withColumn("__ratio", ratio)
        .withColumn("__full", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("__rest", F.sum("weight").over(onward))
        .withColumn("__filled", (F.col("weight") > 0) & filled)
        .withColumn("__open", F.when(~F.col("__filled"), F.col("weight")).otherwise(0.0))
        .withColumn("__used", F.sum(F.when(F.col("__filled"), F.col("capacity")).otherwise(0)).over(all_))
        .withColumn("__sum", F.sum("__open").over(all_))
    )
    exact = F.when(F.col("__filled"), F.col("capacity").cast("double")).when(
        F.col("__sum") > 0, F.col("__open") * (F.col(budget) - F.col("__used")) / F.col("__sum")
    ).otherwise(0.0)
    df = df.withColumn("__exact", F.least(exact, F.col("capacity").cast("double"))).withColumn("__whole", F.floor("__exact").cast("long"))
    room = (F.col("__whole") < F.col("capacity")) & (F.col("weight") > 0)
    df = (
        df.withColumn("__room", room.cast("int"))
        .withColumn("__left", F.least(F.col(budget), F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(all_)) - F.sum("__whole").over(all_))
        .withColumn("__rank", F.row_number().over(all_.orderBy(F.desc("__room"), F.desc(F.col("__exact") - F.col("__whole")), *child)))
        .withColumn(out, F.col("__whole") + F.when((F.col("__room") == 1) & (F.col("__rank") <= F.col("__left")), 1).otherwise(0))
    )
    return df.drop("__ratio", "__full", "__rest", "__filled", "__open", "__used", "__sum", "__exact", "__whole", "__room", "__left", "__rank")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[str], target: Column, epochs: int = EPOCHS) -> DataFrame:
    """``leaves`` (the levels, ``tokens``, one weight column per level) with ``budget`` added, and ``open``: no weight on its way is 0.

    A weight column is read as the weight of the node at its level (its largest
    value among the node's leaves). ``target`` is an aggregate over the leaves.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * epochs)
    nodes = tree.groupBy().agg(F.least(target.cast("long"), F.sum("capacity")).alias("__b0")).withColumns(
        {"__root": F.lit(0), "__open0": F.lit(True)}
    )
    parents: list[str] = ["__root"]
    tree = tree.withColumn("__root", F.lit(0))
    for i, (level, weight) in enumerate(zip(levels, weights)):
        own = [*parents, level]
        children = tree.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.max(weight).alias("weight"))
        children = join_alike(children, nodes, parents, "left")
        given = share(children, parents, [level], f"__b{i}", f"__b{i + 1}")
        nodes = given.select(*own, f"__b{i + 1}", (F.col(f"__open{i}") & (F.col("weight") > 0)).alias(f"__open{i + 1}"))
        parents = own
    return join_alike(tree, nodes, parents, "left").select(
        *leaves.columns, F.col(f"__b{len(levels)}").alias("budget"), F.col(f"__open{len(levels)}").alias("open")
    )


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column | None = None, keep: Sequence[str] = (),
    epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """One row per document and epoch taken: levels, doc_id, ``keep``, epoch, start (in its leaf's stream), n_tokens, taken.

    ``docs`` has doc_id, n_tokens and the levels; ``weights`` are columns over the
    levels; ``target`` is an aggregate over leaves with ``tokens`` (default: as many
    tokens as there are).
    """
    levels = list(levels)
    names = [f"__w{i}" for i in range(len(levels))]
    named = [*levels, "doc_id", "n_tokens", *keep]
    rows = docs.select(*named).groupBy(*named).agg(F.count(F.lit(1)).alias("__m"))
    leaves = rows.groupBy(*levels).agg(F.sum(F.col("n_tokens") * F.col("__m")).alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = leaves.withColumns(dict(zip(names, weights)))
    given = budgets(leaves, levels, names, F.sum("tokens") if target is None else target, epochs)
    plan = stage(
        given.where("budget > 0 OR open").select(
            *levels, "budget", "tokens", "open",
            F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("whole"),
            F.ceil(F.sqrt("rows")).cast("long").alias("buckets"),
        ), "mix-plan",
    )
    taken = join_alike(rows, plan, levels)
    # epoch numbers 0 .. whole; the last is the one that is cut
    each = taken.select("*", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("epoch"))
    first = F.col("open") & (F.col("n_tokens") == 0) & (F.col("epoch") == 0)
    each = each.where((F.col("epoch") < F.col("whole")) | (F.col("budget") > F.col("whole") * F.col("tokens")) | first)
    order = F.xxhash64("doc_id", "epoch", "n_tokens", *keep, F.lit(seed))
    each = each.withColumn("__h", order).withColumn("__k", F.pmod(F.shiftright("__h", 20), F.col("buckets")))
    leaf = [*levels, "epoch"]
    sums = each.groupBy(*leaf, "__k").agg(F.sum(F.col("n_tokens") * F.col("__m")).alias("__s"))
    ahead = Window.partitionBy(*leaf).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__s").over(ahead), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*leaf, "__k").orderBy("__h", "doc_id", "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__in", F.coalesce(F.sum(F.col("n_tokens") * F.col("__m")).over(inside), F.lit(0)))
    placed = join_alike(each, sums, [*leaf, "__k"])
    placed = placed.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)))
    start = F.col("epoch") * F.col("tokens") + F.col("__ahead") + F.col("__in") + F.col("__nth") * F.col("n_tokens")
    # a text without tokens that the budget does not reach stands at the end of what is taken
    placed = placed.withColumn("start", F.when(F.col("n_tokens") > 0, start).otherwise(F.least(start, F.col("budget"))))
    fits = F.when(F.col("n_tokens") > 0, F.col("start") < F.col("budget")).otherwise((F.col("epoch") < F.col("whole")) | first)
    return placed.where(fits).select(
        *levels, "doc_id", *keep, "epoch", "start", "n_tokens",
        F.least(F.col("n_tokens"), F.col("budget") - F.col("start")).alias("taken"),
    )


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th token."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\s*\S+"), F.lit(0))
    return F.array_join(F.slice(parts, 1, n.cast("int")), "")
