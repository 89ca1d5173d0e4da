"""Replies assembled as their lines stream in.

Lines are parsed by Spark; the operator keeps, per open request, the parts of the
text so far, the lines that arrived ahead of their turn, and one small row on how
far it is, and gives one row when the request ends. A batch appends a part and
adds or removes short runs of lines, so what it writes is in proportion to the batch,
not to the reply. The text is capped, and a closed request keeps only a mark. A
service that never stops names how long the mark is kept; a run that ends with
its input must not, because processing-time timers always want another batch.

State of several columns needs Spark's RocksDB store: ``start_replies`` starts a
stream with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkdesk.functions.text import trimmed
from sparkdesk.operators.replies import _EVENT, MAX_LINE_BYTES, MAX_REPLY_BYTES, assemble, line_events

MAX_WAITING = 100_000  # lines of one request held ahead of a missing one
MAX_LINES = 10_000  # lines of one request taken at a time
RUN = 1_000  # lines, and characters, of one entry of lines ahead
RUN_CHARS = 1 << 20

REPLY_COLUMNS = "request_id long, reply string, truncated boolean, failed boolean, prompt long, completion long"
_PROGRESS = "closed boolean, next long, size long, ahead long, least long, runs long, truncated boolean, prompt long, completion long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(request_id, seq, token, steps): what each line does. A line that only
    says a token has it as it is, any other its steps in order, as JSON; a line
    that does nothing has neither but keeps its place."""
    body = trimmed(F.col("line"))
    oversized = F.octet_length("line") > max_line_bytes
    data = F.when(~oversized & body.startswith("data:"), trimmed(F.substr(body, F.lit(6))))
    done = F.array(F.struct(
        F.lit("done").alias("kind"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("prompt"),
        F.lit(None).cast("long").alias("completion"),
    ))
    plain = (F.size("steps") == 1) & (F.get("steps", F.lit(0))["kind"] == "token")
    return (
        lines.select("request_id", "seq", data.alias("data"), oversized.alias("oversized"))
        .withColumn("v", F.from_json("data", _EVENT))
        .select(
            "request_id", "seq",
            F.when(F.coalesce(F.col("data") == "[DONE]", F.lit(False)), done)
            .otherwise(line_events(F.col("v"), F.col("oversized"), F.lit(False))).alias("steps"),
        )
        .select(
            "request_id", "seq", F.when(plain, F.get("steps", F.lit(0))["token"]).alias("token"),
            F.when(~plain & (F.size("steps") > 0), F.to_json("steps")).alias("steps"),
        )
    )


class _Progress:
    """How far a request is: what one batch reads and writes whole."""

    def __init__(self, held: tuple | None):
        self.closed, self.next, self.size, self.ahead, self.least, self.runs, self.truncated, self.prompt, self.completion = held or (
            False, 0, 0, 0, None, 0, False, None, None
        )
        self.failed, self.new, self.kept = False, [], self.size > 0

    def row(self) -> tuple:
        return (
            self.closed, self.next, self.size, self.ahead, self.least, self.runs, self.truncated, self.prompt, self.completion
        )

    def say(self, token: str, max_bytes: int) -> bool:
        n = len(token.encode())
        if self.size + n > max_bytes:
            self.truncated = True
            return True
        self.new.append(token)
        self.size += n
        return False

    def take(self, line: tuple, max_bytes: int) -> bool:
        """Apply one line (token, steps); True if it ends the request."""
        token, steps = line
        if token is not None:
            return self.say(token, max_bytes)
        for step in json.loads(steps) if steps else ():
            kind = step["kind"]
            if kind == "token":
                if self.say(step["token"], max_bytes):
                    return True
            elif kind == "usage":
                self.prompt, self.completion = step.get("prompt"), step.get("completion")
            elif kind == "truncated":
                self.truncated = True
            else:
                self.failed = kind == "error"
                return True
        return False


class Assembler(StatefulProcessor):
    """State of one request: ``progress``, the ``parts`` of its text, and ``ahead``, runs of lines that came before their turn.

    Every access to state is a message to the JVM, so lines ahead are kept a run
    an entry, under the run's first line and its number, and read again only
    when that line's turn has come. Of a line in several runs the last stands.
    """

    def __init__(self, max_bytes: int, keep_closed_ms: int | None, quiet_ms: int | None, max_waiting: int):
        self.max_bytes, self.keep_closed_ms, self.quiet_ms, self.max_waiting = max_bytes, keep_closed_ms, quiet_ms, max_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.parts = handle.getListState("parts", "text string")
        self.ahead = handle.getMapState("ahead", "first long, number long", "lines string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        p = _Progress(self.progress.get())
        if p.closed:
            return
        for some in _portions(rows):
            if self._advance(p, some):
                yield self._ended(key[0], p)
                break
        self._keep(p)
        self.progress.update(p.row())
        wait = self.keep_closed_ms if p.closed else self.quiet_ms
        if wait is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        p = _Progress(self.progress.get())
        if p.closed:
            self.progress.clear()
            return
        # nothing came for a while: what has arrived is the reply, over any gap
        waiting = {}
        if p.ahead:
            self._load(p, waiting, list(self.ahead.keys()))
        for q in sorted(waiting):
            if p.take(waiting[q][1], self.max_bytes):
                break
        yield self._ended(key[0], p)
        self.progress.update(p.row())
        if self.keep_closed_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_closed_ms)

    def _advance(self, p: _Progress, fresh: dict[int, tuple]) -> bool:
        """Take the lines whose turn it is and keep the others; True if the request ends."""
        waiting = {q: (p.runs, line) for q, line in fresh.items() if q >= p.next}
        p.runs += 1
        keys = None
        while True:
            if p.ahead and p.least <= p.next:
                if keys is None:
                    keys = sorted(((int(k[0]), int(k[1])) for k in self.ahead.keys()), reverse=True)
                due = []
                while keys and keys[-1][0] <= p.next:
                    due.append(keys.pop())
                self._load(p, waiting, due)
                p.least = keys[-1][0] if keys else None
            if p.next not in waiting:
                break
            _, line = waiting.pop(p.next)
            p.next += 1
            if p.take(line, self.max_bytes):
                return True
        self._wait(p, waiting)
        if p.ahead > self.max_waiting:  # lines that came twice count once
            every = {}
            self._load(p, every, list(self.ahead.keys()))
            p.least = None
            self._wait(p, every)
        self._keep(p)
        p.failed = p.ahead > self.max_waiting
        return p.failed

    def _load(self, p: _Progress, waiting: dict[int, tuple], keys: list) -> None:
        """Take runs out of the state."""
        for k in keys:
            first, number = int(k[0]), int(k[1])
            lines = json.loads(self.ahead.getValue((first, number))[0])
            self.ahead.removeKey((first, number))
            p.ahead -= len(lines)
            for q, token, steps in lines:
                if q >= p.next and (q not in waiting or waiting[q][0] < number):
                    waiting[q] = (number, (token, steps))

    def _wait(self, p: _Progress, waiting: dict[int, tuple]) -> None:
        """Put lines into the state, in runs of a bounded length."""
        runs: dict[int, list] = {}
        for q in sorted(waiting):
            number, line = waiting[q]
            runs.setdefault(number, []).append((q, *line))
        for number, lines in runs.items():
            for at, end in _runs(lines):
                self.ahead.updateValue((lines[at][0], number), (json.dumps(lines[at:end]),))
            p.ahead += len(lines)
            p.least = lines[0][0] if p.least is None else min(p.least, lines[0][0])

    def _keep(self, p: _Progress) -> None:
        if p.new and not p.closed:
            self.parts.appendValue(("".join(p.new),))
            p.kept = True
        p.new = []

    def _ended(self, request, p: _Progress) -> Row:
        before = (part[0] for part in self.parts.get()) if p.kept else ()
        text = None if p.failed else "".join([*before, *p.new])
        if p.kept:
            self.parts.clear()
        if p.ahead:
            self.ahead.clear()
        p.closed, p.ahead, p.least = True, 0, None
        return Row(request_id=request, reply=text, truncated=p.truncated, failed=p.failed, prompt=p.prompt, completion=p.completion)


def _portions(rows) -> Iterator[dict[int, tuple]]:
    """The lines of a request's runs by place, some thousands at a time."""
    some = {}
    for r in rows:
        some.update((q, (token, steps)) for q, (token, steps) in enumerate(json.loads(r["lines"]), r["first"]))
        if len(some) >= MAX_LINES:
            yield some
            some = {}
    if some:
        yield some


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(request_id, first, lines): parsed lines that follow each other, in one row.

    A row costs the state step far more than a line does, and a file mostly has
    a request's lines together."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch, [("request_id", "ascending"), ("seq", "ascending")]))
        request, seq, token, steps = (batch.column(n).to_pylist() for n in ("request_id", "seq", "token", "steps"))
        out, at = [], 0
        for i in range(1, len(seq) + 1):
            if i == len(seq) or request[i] != request[at] or seq[i] != seq[i - 1] + 1:
                run = list(zip(seq[at:i], token[at:i], steps[at:i]))
                out += [(request[at], run[a][0], json.dumps([x[1:] for x in run[a:b]])) for a, b in _runs(run)]
                at = i
        ids, firsts, lines = zip(*out) if out else ((), (), ())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lines, pa.string())], names=["request_id", "first", "lines"])


def _runs(lines: list) -> Iterator[tuple[int, int]]:
    """Cut lines (seq, token, steps) into runs of at most ``RUN`` lines and, beyond one line, ``RUN_CHARS`` characters."""
    at = held = 0
    for i, (_, token, steps) in enumerate(lines):
        n = len(token or "") + len(steps or "")
        if i > at and (i - at >= RUN or held + n > RUN_CHARS):
            yield at, i
            at, held = i, 0
        held += n
    yield at, len(lines)


def assembled(
    lines: DataFrame,
    max_bytes: int = MAX_REPLY_BYTES,
    max_line_bytes: int = MAX_LINE_BYTES,
    keep_closed_ms: int | None = None,
    quiet_ms: int | None = None,
    max_waiting: int = MAX_WAITING,
) -> DataFrame:
    """One row per request, when it ends.

    A request that hears nothing for ``quiet_ms`` ends with what has arrived; one
    with more than ``max_waiting`` lines ahead of a missing line fails. Where
    input is bounded, ``open_requests`` has those that no line or time ended.
    """
    untimed = keep_closed_ms is None and quiet_ms is None
    return (
        parsed(lines, max_line_bytes).mapInArrow(packed, "request_id long, first long, lines string").groupBy("request_id")
        .transformWithState(
            Assembler(max_bytes, keep_closed_ms, quiet_ms, max_waiting), REPLY_COLUMNS, "append", "none" if untimed else "processingTime"
        )
    )


def start_replies(replies: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the replies of ``assembled`` as they end; the session's own state store setting stays as it was."""
    conf = replies.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKSDB)
    try:
        return (
            replies.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        conf.set(_STORE, before) if before else conf.unset(_STORE)


def open_requests(lines: DataFrame, emitted: DataFrame, max_bytes: int = MAX_REPLY_BYTES, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """The replies of bounded input that the stream has not emitted, as far as they arrived."""
    rest = lines.join(emitted.select("request_id").distinct(), "request_id", "left_anti")
    return assemble(rest, max_bytes, max_line_bytes)
