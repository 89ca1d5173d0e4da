"""Near duplicates by fast similarity sketches, bands, and exact verification.

A document is the set of its distinct word shingles, each a 64-bit fingerprint
of the words. Rounds of hashing throw every shingle into a bin; a bin keeps its
smallest (round, value), and after at most twice as many rounds as bins every
bin is full, so also tiny sets get whole sketches. Four bins make a band key.

Equal sets are one class, found by a hash of the set, and only its smallest id
goes on. In a band bucket every member is paired with one leader; each band
draws another leader. Pairs are verified on full sets, and components follow.
Where a bucket still spans several components, its members outside the leader's
component meet all members, in blocks that carry the full sets, bounded by rows
and by shingles: a pair that the bucket is the first to show, of different
components and with like sketches, is verified on the spot, and two components
need one link. So no pair is ever a row, and no link between components that the
bands show is lost.

Joins on a bucket split the large ones: at most ``HOT_BUCKETS`` can hold more than
that share of all entries, so their leaders are broadcast; later joins know a
bucket's size and cut it by hashed id.

Defined results: a null or empty text has an empty set and is its own component;
rows that share an id are one document, with the links of any of them; a row
without an id takes part in nothing, has no component and is kept; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import stage
from sparkdesk.llm.graphs import components

WORDS = 5
PERCENT = 75
BINS = 128
ROWS = 4  # bins in a band; a pair at the threshold is missed by all 32 bands once in 200,000
ALIKE = 70  # equal bins of 128 that a pair needs to be verified later: 5 deviations under the threshold
MINOR_BLOCK, MAJOR_BLOCK = 512, 2048
BLOCK_ITEMS = 4_000_000  # shingles of a side of a block, nearly; one set is never cut
HOT_ROWS = 1024  # rows of a bucket that one task of a join takes
HOT_BUCKETS = 100_000  # of 32 bytes each: the most that are broadcast

_SKETCHED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _ODD)
_BANDS = _mix(np.arange(1001, 1001 + BINS // ROWS, dtype=np.uint64) * _ODD)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct fingerprints; only A-Z are lowered and only ASCII white space parts words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=n)
    size = min(words, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total = (total * _ODD) ^ _mix(h[j : n - size + 1 + j] + np.uint64(j))
    return np.unique(_mix(total))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty."""
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, 2048 // len(items))  # small sets take many rounds at once
    mask = np.uint64(bins - 1)
    for i in range(0, 2 * bins, step):
        rounds = np.arange(i, min(i + step, 2 * bins))
        x = _mix(items[None, :] ^ _SEEDS[rounds, None])
        at = (x & mask).astype(np.int64)
        at[rounds >= bins] = (rounds[rounds >= bins] - bins)[:, None]
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (x >> np.uint64(16))
        np.minimum.at(out, at.ravel(), value.ravel())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(sketched: np.ndarray, rows: int = ROWS) -> np.ndarray:
    keys = _BANDS.copy()
    for column in sketched.reshape(-1, rows).T:
        keys = _mix((keys * _ODD) ^ column)
    return keys.view(np.int64)


def sketch_documents(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, sigs = [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text)
                sizes.append(len(items))
                if len(items):
                    s = sketch(items)
                    keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(s))
                    sigs.append((s & np.uint64(0xFF)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                ],
                names=[c.split()[0] for c in _SKETCHED.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SKETCHED)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the documents in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(items, pa.list_(pa.int64()))], names=["id", "items"]
            )

    # always by shuffle: a plan that broadcasts the ids of a small table says nothing about a large one
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return wanted.mapInArrow(run, "id long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return (
        both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("total"))
        .where(F.col("n") * 100 >= (F.col("total") - F.col("n")) * percent).select("a", "b").distinct()
    )


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _likeness(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, Callable]:
    """Minor and other rows of a block, codes of their components, and what a minor row may be near to."""
    x, y = f[f["minor"]].reset_index(drop=True), f[~f["minor"]].reset_index(drop=True)
    sigs = np.frombuffer(b"".join(y["sig"]), dtype=np.uint8).reshape(len(y), BINS)
    keys = np.stack(y["bands"]) if len(y) else np.empty((0, BINS // ROWS), dtype=np.int64)
    ids, sizes = y["id"].to_numpy(), y["n_items"].to_numpy()
    codes, _ = pd.factorize(pd.concat([y["component"], x["component"]]))
    band, leader = int(f["band"].iloc[0]), f["leader"].iloc[0]

    def look(i: int) -> np.ndarray:
        """Rows of ``y`` that this bucket is the first to show with row i of ``x``, with like sketches."""
        if x["id"][i] == leader:
            return np.zeros(len(y), dtype=bool)
        n = x["n_items"][i]
        shared = keys[:, : band + 1] == np.asarray(x["bands"][i])[: band + 1]
        same = (sigs == np.frombuffer(x["sig"][i], dtype=np.uint8)).sum(axis=1)
        return (
            shared[:, band] & ~shared[:, :band].any(axis=1) & (same >= ALIKE) & (ids != leader)
            & (sizes * 100 >= n * PERCENT) & (n * 100 >= sizes * PERCENT)
        )

    return x, y, codes[len(y) :], codes[: len(y)], look


def _links_between(f: pd.DataFrame) -> pd.DataFrame:
    """Links of the ``minor`` rows with the others, enough to join their components."""
    x, y, own, comp, look = _likeness(f.assign(n_items=f["items"].map(len)))
    ids, sizes, items = y["id"].to_numpy(), y["n_items"].to_numpy(), y["items"].to_numpy()
    root = np.arange(len(x) + len(y))  # of each component, as links join them
    a, b = [], []
    for i in range(len(x)):
        c, mine = own[i], np.sort(x["items"][i])  # in the order of signed integers
        n = len(mine)
        at = np.flatnonzero(look(i) & (root[comp] != root[c]))
        if not len(at):
            continue
        flat = np.concatenate([items[j] for j in at])
        place = np.minimum(np.searchsorted(mine, flat), n - 1)
        common = np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(sizes[at]) - sizes[at])
        for j in at[common * 100 >= (sizes[at] + n - common) * PERCENT]:
            if root[comp[j]] != root[c]:
                root[root == root[comp[j]]] = root[c]
                a.append(min(x["id"][i], ids[j]))
                b.append(max(x["id"][i], ids[j]))
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _by_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of (bucket, id, n) with the facts of their bucket; a bucket of n rows is cut by hashed id."""
    parts = F.ceil(F.col("n") / HOT_ROWS)
    cut = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), parts))
    every = facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    return cut.join(every, ["bucket", "part"]).drop("part")


def _missing_links(members: DataFrame, comps: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, beyond those with its leader."""
    labelled = (
        members.where("n > 2").join(comps.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    main = F.max(F.when(F.col("id") == F.col("leader"), F.col("component")))
    mixed = (
        labelled.groupBy("bucket", "n").agg(main.alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("bucket", "n", "main")
    )
    rows = stage(_by_bucket(labelled, mixed).join(sigs.select("id", "n_items"), "id"), "near-mixed")
    minor = F.col("component") != F.col("main")
    blocks = lambda count, items, most: F.ceil(F.greatest(count / most, items / BLOCK_ITEMS)).cast("int")
    facts = rows.groupBy("bucket", "n").agg(
        blocks(F.count_if(minor), F.sum(F.when(minor, F.col("n_items"))), MINOR_BLOCK).alias("bi"),
        blocks(F.count(F.lit(1)), F.sum("n_items"), MAJOR_BLOCK).alias("bj"),
    )
    rows = _by_bucket(rows, facts).join(sigs.drop("n_items"), "id").join(sets, "id")
    spread = F.xxhash64("id", F.lit(7))
    keep = ["bucket", "band", "id", "component", "leader", "sig", "bands", "items"]
    small = rows.where(minor).select(
        *keep, F.lit(True).alias("minor"), F.pmod(spread, F.col("bi")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("j"),
    )
    every = rows.select(
        *keep, F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("i"),
        F.pmod(spread, F.col("bj")).cast("int").alias("j"),
    )
    return small.unionByName(every).groupBy("bucket", "i", "j").applyInPandas(_links_between, "a long, b long").distinct()


def _with_leaders(entries: DataFrame, leaders: DataFrame, total: int) -> DataFrame:
    """Entries with their bucket's leader; the buckets that hold a large share of ``total`` aren't shuffled."""
    # sizes add up to the total, so no more than HOT_BUCKETS can reach this one
    large = F.col("n") >= max(HOT_ROWS, -(-total // HOT_BUCKETS))
    hot = leaders.where(large)
    rest = entries.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti")
    return entries.join(F.broadcast(hot), "bucket").unionByName(rest.join(leaders.where(~large), "bucket"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sketched = stage(sketch_documents(docs), "near-sketches")
    classes = (
        sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(
            F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
            F.first("n_shingles").alias("n_items"),
        )
    )
    classes = stage(classes, "near-classes")
    entries = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    leaders = (
        entries.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id")).alias("l"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("bucket", F.col("l.id").alias("leader"), "n")
    )
    members = stage(_with_leaders(entries, stage(leaders, "near-leaders"), classes.count() * (BINS // ROWS)), "near-members")
    pairs = stage(members.where("id <> leader").select(*_ordered("id", "leader")).distinct(), "near-pairs")
    sets = stage(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "near-sets")
    links = verified(pairs, sets)
    # rows of one id may stand in several classes: they meet in that id
    known = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key")
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y")
    repeated = (
        known.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key")
        .where("doc_id <> id").select(*_ordered("doc_id", "id"))
    )
    links = stage(links.unionAll(repeated.distinct()), "near-links")
    comps = components(links)
    later = stage(_missing_links(members, comps, classes.select("id", "n_items", "sig", "bands"), sets), "near-later")
    if not later.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(later), "near-final")
    own = classes.select("set_key", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("of_class")
    )
    found = sketched.select("doc_id", "n_shingles", "set_key").join(own, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )
