"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import stage


def _minima(edges: DataFrame) -> DataFrame:
    """Smallest of each node and its neighbours; ``edges`` hold both directions."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest id reachable, for every id in ``links`` (a, b).

    Large and small stars alternate until nothing moves. A node's neighbours are
    never gathered: their minimum is aggregated before the shuffle and joined back.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    state = _state(edges)
    while state[0]:
        both = _both(edges)
        large = (
            both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.join(_minima(down), "u")
        edges = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            name,
        )
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select("u", "v")
    return roots.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("v"), F.col("v")).distinct()
    )
