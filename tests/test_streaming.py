"""Replies assembled by a stream, over many batches, against the same lines at once."""

import random
import time

from sparkdesk.operators.replies import assemble
from sparkdesk.streaming import replies as SR

LINES = "request_id long, seq long, line string"


def token(text):
    return 'data: {"choices":[{"delta":{"content":"%s"}}]}' % text


def written(spark, source, batches):
    for rows in batches:
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(source)


def run(spark, tmp_path, batches, **limits):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    written(spark, source, batches)
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source)
    query = SR.start_replies(SR.assembled(lines, **limits), out, checkpoint)
    query.awaitTermination(240)
    assert query.exception() is None
    rows = [tuple(r) for r in spark.read.schema(SR.REPLY_COLUMNS).parquet(out).collect()]
    return sorted(rows), query.recentProgress


def test_any_order_gives_the_same_replies(spark, tmp_path):
    """Lines out of order, again and after the end, in five batches."""
    rng = random.Random(2)
    said = {r: [token(f"{r}.{i} ") for i in range(rng.randrange(1, 12))] + ["data: [DONE]"] for r in range(6)}
    rows = [(r, i, line) for r, lines in said.items() for i, line in enumerate(lines)]
    once = sorted((r.request_id, r.reply) for r in assemble(spark.createDataFrame(rows, LINES)).collect())
    rng.shuffle(rows)
    cut = len(rows) // 4 + 1
    batches = [rows[i : i + cut] for i in range(0, len(rows), cut)] + [rng.sample(rows, 6)]
    got, _ = run(spark, tmp_path, batches)
    assert [(r[0], r[1]) for r in got] == once


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    """A long reply grows by a part a batch; nothing written before is written again."""
    batches = [[(1, 40 * b + i, token("x" * 200)) for i in range(40)] for b in range(4)] + [[(1, 160 + b, token("y"))] for b in range(3)]
    got, progress = run(spark, tmp_path, batches + [[(1, 163, "data: [DONE]")]])
    assert [r[:4] for r in got] == [(1, "x" * 200 * 160 + "yyy", False, False)]
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    assert len(updated) == 8 and max(updated[:7]) <= 4


def test_too_many_lines_ahead_fail(spark, tmp_path):
    got, _ = run(spark, tmp_path, [[(1, i, token("a")) for i in range(1, 9)], [(2, 0, token("b")), (2, 1, "data: [DONE]")]], max_waiting=5)
    assert [(r[0], r[1], r[3]) for r in got] == [(1, None, True), (2, "b", False)]


def test_a_quiet_request_ends_over_its_gap(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    written(spark, source, [[(1, 0, token("a")), (1, 2, token("c"))]])
    lines = spark.readStream.schema(LINES).parquet(source)
    query = SR.start_replies(SR.assembled(lines, quiet_ms=500, keep_closed_ms=500), out, checkpoint, processingTime="1 second")
    try:
        rows, until = [], time.time() + 60
        while not rows and time.time() < until:
            time.sleep(1)
            rows = spark.read.schema(SR.REPLY_COLUMNS).parquet(out).collect() if any((tmp_path / "out").glob("*.parquet")) else []
    finally:
        query.stop()
    assert [(r.request_id, r.reply, r.failed) for r in rows] == [(1, "ac", False)]


def test_lines_ahead_are_kept_in_runs(spark, tmp_path):
    """Lines ahead, sent twice and in overlapping parts, make a few entries of state; each counts once."""
    line = lambda i: (1, i, token(f"{i} "))
    batches = [
        [line(i) for i in range(200, 500)], [line(i) for i in range(100, 300)], [line(i) for i in range(200, 500)],
        [line(i) for i in range(0, 90)], [line(i) for i in range(95, 100)], [line(i) for i in range(90, 95)], [(1, 500, "data: [DONE]")],
    ]
    got, progress = run(spark, tmp_path, batches, max_waiting=450)
    assert [r[:4] for r in got] == [(1, "".join(f"{i} " for i in range(500)), False, False)]
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    assert len(updated) == 7 and max(updated) <= 8
