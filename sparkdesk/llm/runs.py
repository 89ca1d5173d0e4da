"""Periodic runs of words, found from Lyndon arrays that a suffix sorter's first phase yields.

A run of period q is a stretch of words that repeats every q words and that
neither neighbour carries on. For one of two opposite orders of the words, the
longest Lyndon word at some place of the run's first period is q words long, so
two Lyndon arrays name every run.

The arrays come from the grouping phase of Baier's suffix sorter. Positions are
grouped by their first word; groups are processed from the greatest down. A
group's members are final, and each hands its context to the nearest position on
its left that is not processed yet: such positions, split by how many contexts
they take, move to new groups just above their old one. A position's context,
once its group is processed, is the longest Lyndon word that starts there.

Each Lyndon root is then extended to both sides by longest common extensions:
slices of twice the last length are compared until they differ. A root inside a
run of its period that is known already is passed over, so no run is walked twice.

A run here is ``REPEATS`` periods long at least, so each of its words occurs that
often in it. Words that occur less often between two such words part a text, and
this is repeated on what is left; the parts are whole to every run and are
grouped apart. That is exact, and leaves little of a plain text to sort.

Texts stay in their task; nothing is shuffled. Texts are taken in turns of
``SLICE`` bytes, and a longer one by itself. Work grows with the words of a text.

Defined results: a null or empty text has no words, no runs and the checksums of
nothing; every row stands by itself, also if ids repeat; the query's repeated
passages need an id, so a null id leaves its words as they are; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

REPEATS = 4
SHORTEST = 6
SLICE = 2 << 20

Run = tuple[int, int, int]  # start, length, period

_SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon_array(words: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, by grouping alone."""
    n = len(words)
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    members = [places[w] for w in sorted(places)]  # groups, in order at first; later ones are linked in
    context = [1] * len(members)
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    out = [0] * n
    left = list(range(-1, n - 1))  # a place on the left of which nothing up to this one is unprocessed
    done = bytearray(n)
    top = len(members) - 1
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        members[top] = []
        size = context[top]
        for i in here:
            out[i] = size
            done[i] = 1
        taken: dict[int, int] = {}
        for i in here:
            j = left[i]
            while j >= 0 and done[j]:
                j = left[j]
            k = i
            while left[k] != j:  # shorten the way for the next
                k, left[k] = left[k], j
            if j >= 0:
                taken[j] = taken.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in taken.items():
            moved.setdefault((group[j], times), []).append(j)
        at: dict[int, int] = {}  # the last group put above an old one
        for g, times in sorted(moved):
            new, below = len(members), at.get(g, g)
            members.append(moved[g, times])
            context.append(context[g] + times * size)
            above = upper[below]
            lower.append(below)
            upper.append(above)
            upper[below] = lower[above] = new
            at[g] = new
            for j in moved[g, times]:
                group[j] = new
        top = lower[top]
    return out


def _common(view: memoryview, i: int, j: int, most: int, back: bool) -> int:
    """How many words from i and j on (or before them, if ``back``) are equal, at most ``most``."""
    same, step = 0, 16
    while same < most:
        step = min(step, most - same)
        if _equal(view, i, j, same, step, back):
            same += step
            step *= 2
            continue
        while step > 1:
            half = step // 2
            if _equal(view, i, j, same, half, back):
                same += half
                step -= half
            else:
                step = half
        break
    return same


def _equal(view: memoryview, i: int, j: int, skip: int, size: int, back: bool) -> bool:
    a, b = (i - skip - size, j - skip - size) if back else (i + skip, j + skip)
    return view[4 * a : 4 * (a + size)] == view[4 * b : 4 * (b + size)]


def runs_of(words: np.ndarray) -> list[Run]:
    """All runs of ``REPEATS`` periods and ``SHORTEST`` words at least, by start and period."""
    n, values = len(words), words.tolist()
    view = memoryview(np.ascontiguousarray(words, dtype="<u4").tobytes())
    places = np.arange(n)
    roots = set()
    for order in (values, [-w for w in values]):
        period = np.array(lyndon_array(order), dtype=np.int64)
        fits = places + (REPEATS - 1) * period <= n
        fits[fits] = words[places[fits]] == words[(places + period)[fits]]
        roots.update(zip(places[fits].tolist(), period[fits].tolist()))
    found, ends = [], {}
    for i, p in sorted(roots):
        # the root of a run starts in its first period, so all but two periods of the run repeat from there
        if ends.get(p, 0) >= i + p or not _equal(view, i, i + p, 0, (REPEATS - 2) * p, False):
            continue
        start = i - _common(view, i, i + p, i, True)
        end = i + p + _common(view, i, i + p, n - i - p, False)
        ends[p] = end
        if end - start >= max(SHORTEST, REPEATS * p):
            found.append((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def parts(codes: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) that hold every run: each word occurs ``REPEATS`` times in its stretch, or nearly.

    ``codes`` are words, equal only within a text; ``text`` is the number of the text.
    """
    at = np.flatnonzero(np.bincount(codes, minlength=1)[codes] >= REPEATS)
    for _ in range(6):  # more rounds would cut more, never anything that matters
        if not len(at):
            return []
        breaks = np.append(True, (np.diff(at) != 1) | (np.diff(text[at]) != 0))
        part = np.cumsum(breaks) - 1
        size = np.bincount(part)
        _, word, times = np.unique(part * (len(codes) + 1) + codes[at], return_inverse=True, return_counts=True)
        kept = (size[part] >= SHORTEST) & (times[word] >= REPEATS)
        if kept.all():
            break
        at = at[kept]
    if not len(at):
        return []
    breaks = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(text[at]) != 0)))
    ends = np.append(breaks[1:], len(at))
    return [(int(at[b]), int(at[e - 1]) + 1) for b, e in zip(breaks, ends) if e - b >= SHORTEST]


def search(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words."""
    codes = np.empty(sum(map(len, texts)), dtype=np.int64)
    at = 0
    for words in texts:
        codes[at : at + len(words)] = list(map({}.setdefault, words, itertools.count(at)))
        at += len(words)
    sizes = [len(words) for words in texts]
    text, begins = np.repeat(np.arange(len(texts)), sizes), np.cumsum([0, *sizes])
    found: list[list[Run]] = [[] for _ in texts]
    for begin, end in parts(codes, text):
        t = int(text[begin])
        shift = begin - int(begins[t])
        found[t] += [(start + shift, length, period) for start, length, period in runs_of(codes[begin:end] - begins[t])]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but for those that a run holds after its first period."""
    if runs:
        drop = bytearray(len(words))
        for start, length, period in runs:
            drop[start + period : start + length] = b"\1" * (length - period)
        words = [w for w, d in zip(words, drop) if not d]
    return b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs by (start, period), and the text with its runs collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            begin = 0
            while begin < b.num_rows:
                words, size, end = [], 0, begin
                while end < b.num_rows and size < SLICE:
                    content = (texts[end].as_py() or "").encode()
                    words.append(content.split())
                    size += len(content)
                    end += 1
                found = search(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin), pa.array([len(w) for w in words], pa.int64()),
                        pa.array(
                            [[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found],
                            pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
                        ),
                        pa.array([collapse(w, f).decode() for w, f in zip(words, found)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                begin = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


WHITE = r"[\x20\x09-\x0D]+"


def repeat_passage(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document, by its id's checksum, with a passage up to its end repeated; others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WHITE), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(w, (a + (i - a) % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    # the words are bound to a variable, so that they are split once
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the strongest one, and checksums of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def stronger(best: Column, r: Column) -> Column:
        # runs come by (start, period), so the first of equals stays
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", F.aggregate("runs", none, stronger)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
