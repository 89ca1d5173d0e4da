"""Stupid-backoff scores of documents under the n-grams of the whole corpus.

Relations: batches (batch, texts), n-grams (batch, bucket, sorted distinct
hashes with their counts in the batch), totals (n-gram, count) inside each hash
bucket, and replies (batch, bucket, counts) in the order of the request. The
n-grams are exploded and counted per batch, grouped by hash bucket for the
totals, and joined back to their batch, where documents are summed. A request
is packed, so an n-gram costs six bytes or so where a row costs thirty.

Score of a word: c(n-gram) / c(its context), if the n-gram was seen at least
``MIN_COUNT`` times in the corpus; else ``ALPHA`` times the score with a context
one word shorter; c(word) / N at the end. Words are cut at ASCII white space and
counted as written. Hashes keep 56 bits: at 10**8 distinct n-grams less than one
pair in all is expected to meet.

Defined results: a null or empty text has 0 words and a null score; repeated
rows count and are scored each; null ids are kept; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import stage

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
BATCH_BYTES = 4 << 20
BUCKET_WORDS = 1_000_000  # words of the corpus per hash bucket

_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEPT = np.uint64((1 << 56) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(docs: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """Neighbouring documents packed together: batch, ids, lengths (words per document), words, body."""
    schema = "batch long, ids binary, words long, body binary"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        part, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def packed() -> pa.RecordBatch:
            words = sum(len(t.split()) for t in texts)
            rows = np.zeros(len(ids), dtype=_HEAD)
            rows["id"] = [i or 0 for i in ids]
            rows["known"] = [i is not None for i in ids]
            rows["bytes"] = [len(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part + made], pa.int64()), pa.array([rows.tobytes()], pa.binary()),
                    pa.array([words], pa.int64()), pa.array([compress(b"".join(texts))], pa.binary()),
                ],
                names=[c.split()[0] for c in schema.split(", ")],
            )

        for frame in frames:
            for i, text in zip(frame.column("doc_id").to_pylist(), frame.column("text").to_pylist()):
                own = (text or "").encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(own)
                held += len(own)
                if held >= size:
                    yield packed()
                    made += 1
                    ids, texts, held = [], [], 0
        if ids:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_HEAD = np.dtype([("id", "<i8"), ("known", "u1"), ("bytes", "<i8")])


def _grams(head: bytes, body: bytes, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(header rows, words per document, hashes of the n-gram that ends at each word, by order).

    Where a document has no full n-gram yet, the hash is 0.
    """
    rows = np.frombuffer(head, dtype=_HEAD)
    text = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(rows["bytes"].sum()) or 1)
    words, lengths, at = [], np.zeros(len(rows), dtype=np.int64), 0
    for i, n in enumerate(rows["bytes"]):
        own = text[at : at + n].split()
        lengths[i] = len(own)
        words += own
        at += n
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, total = [], np.zeros(len(h), dtype=np.uint64)
    for k in range(order):
        moved = np.zeros_like(h)
        moved[k:] = h[: len(h) - k]
        total = total ^ _mix(moved + np.uint64(k) * _ODD)
        g = _mix(total * _ODD + np.uint64(k)) & _KEPT
        g[g == 0] = 1
        g[place < k] = 0
        out.append(g)
    return rows, lengths, out


def _distinct(grams: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ordered by (bucket, hash): buckets, hashes, counts, and the place of every n-gram."""
    flat = np.concatenate(grams)
    found, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    bucket = (found % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return bucket[order], found[order], n[order], back[place]


def _pack_request(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    planes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T  # sorted hashes: the high bytes hardly change
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_request(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(11, -1)
    hashes = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    hashes[:, :7] = planes[:7].T
    return hashes.view("<u8").ravel(), np.ascontiguousarray(planes[7:].T).view("<u4").ravel()


def requests(packed: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, batch, request): the distinct n-grams of each batch, by hash bucket."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for batch, head, body in zip(*(frame.column(c).to_pylist() for c in ("batch", "ids", "body"))):
                bucket, hashes, n, _ = _distinct(_grams(head, body, order)[2], buckets)
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                blobs = [_pack_request(hashes[a:b], n[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts], pa.int64()), pa.array([batch] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["bucket", "batch", "request"],
                )

    return packed.select("batch", "ids", "body").mapInArrow(run, "bucket long, batch long, request binary")


def _answer(f: pd.DataFrame) -> pd.DataFrame:
    asked = [_unpack_request(r) for r in f["request"]]
    found, place = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([n for _, n in asked])).astype("<u8")[place]  # a word may occur more often than 32 bits can tell
    ends = np.cumsum([len(h) for h, _ in asked])
    compress = zstandard.ZstdCompressor(level=1).compress
    replies = [compress(total[b - len(h) : b].view(np.uint8).reshape(-1, 8).T.tobytes()) for (h, _), b in zip(asked, ends)]
    return pd.DataFrame({"batch": f["batch"], "bucket": f["bucket"], "reply": replies})


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, backed_off (words scored without their full context), score (mean log10 per word)."""
    packed = stage(batches(docs), "lm-batches")
    total = packed.agg(F.sum("words")).first()[0] or 0
    if not total:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("backed_off"), F.lit(None).cast("double").alias("score"),
        )
    buckets = -(-total // BUCKET_WORDS)
    replies = requests(packed, order, buckets).groupBy("bucket").applyInPandas(_answer, "batch long, bucket long, reply binary")

    def score(own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        rows, lengths, grams = _grams(own["ids"].iloc[0], own["body"].iloc[0], order)
        _, _, _, place = _distinct(grams, buckets)
        expand = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(expand(r), dtype=np.uint8).reshape(8, -1).T for r in answered.sort_values("bucket")["reply"]]
        counts = np.ascontiguousarray(np.concatenate(parts)).view("<u8").ravel()[place] if parts else np.zeros(0)
        n = int(lengths.sum())
        c = [np.where(g != 0, counts[k * n : (k + 1) * n], 0).astype(float) for k, g in enumerate(grams)]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log10(c[0] / total)
            backed = np.zeros(n, dtype=np.int64)
            for k in range(1, order):
                context = np.concatenate([[1.0], c[k - 1][:-1]]) if n else c[k - 1]
                seen = c[k] >= min_count
                held = grams[k] != 0
                value = np.where(seen, np.log10(c[k] / context), np.where(held, value + np.log10(alpha), value))
                backed = np.where(held, (~seen).astype(np.int64), backed)
        starts = np.cumsum(lengths) - lengths
        sums = np.concatenate([[0.0], np.cumsum(value)])
        offs = np.concatenate([[0], np.cumsum(backed)])
        ids = pd.array(rows["id"].astype(np.int64), dtype="Int64")
        ids[rows["known"] == 0] = pd.NA
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = (sums[starts + lengths] - sums[starts]) / lengths
        return pd.DataFrame({
            "doc_id": ids, "n_words": lengths, "backed_off": offs[starts + lengths] - offs[starts],
            "score": pd.Series(np.where(lengths > 0, np.round(mean, 6), np.nan)),
        })

    scored = packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(
        score, "doc_id long, n_words long, backed_off long, score double"
    )
    return scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
g AS (SELECT doc_id, i, w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM t),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT p, w, count(*) AS n FROM g WHERE p IS NOT NULL GROUP BY p, w),
n AS (SELECT count(*) AS n FROM g),
s AS (SELECT g.doc_id, CASE WHEN g.p IS NOT NULL AND c2.n < 2 THEN 1 ELSE 0 END AS back,
  CASE WHEN c2.n >= 2 THEN log10(c2.n / cp.n) WHEN g.p IS NOT NULL THEN log10(0.4) + log10(cw.n / n.n) ELSE log10(cw.n / n.n) END AS v
  FROM g JOIN c1 cw ON cw.w = g.w CROSS JOIN n LEFT JOIN c2 ON c2.p = g.p AND c2.w = g.w LEFT JOIN c1 cp ON cp.w = g.p)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(a.back, 0) AS backed_off, a.score FROM d LEFT JOIN
  (SELECT doc_id, sum(back)::BIGINT AS back, round(avg(v), 6) AS score FROM s GROUP BY doc_id) a ON a.doc_id = d.doc_id
"""
