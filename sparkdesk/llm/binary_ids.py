"""Token ids in binary files: documents compressed one by one with a shared dictionary.

A folder holds ``dictionary.zdict`` and numbered ``*.ids`` files. A file is

    b"IDS1" | dictionary hash, 8 bytes | documents n, 4 bytes
    n records of (doc_id, 8; has doc_id, 1; ids, 4; end of its bytes in the payload, 8)
    payload: for each document a zstandard frame over its little-endian 32-bit ids

all little-endian, so one document is read from the index and its own bytes.
Files follow ascending doc_id; the numbers of files ascend with them.

The dictionary is trained on ``SAMPLE`` documents at most (those of the smallest
hashed ids), of each ``SAMPLE_IDS`` ids at most; without enough of them there is
none, and the hash is 0. Everything else covers all documents and whole texts.

Files are written by the tasks through Arrow's file systems (local, HDFS, S3 and
others) under a name of their own and moved into place, so a task that is run
again leaves the same files; Spark's ``binaryFile`` source reads them.

Defined results: a null or empty text is its end id alone; null ids come first;
repeated ids stay, in the order of their texts; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm.common import offsets, stage
from sparkdesk.llm.tokens import encoder
from sparkdesk.session import new_path

SAMPLE = 2000
SAMPLE_IDS = 4096
DICTIONARY_BYTES = 65_536
FILE_BYTES = 8 << 20
LEVEL = 3

_MAGIC = b"IDS1"
_INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n", "<u4"), ("end", "<u8")])
_PER_TASK = 1 << 20  # files of one task; numbers of later tasks start beyond


def dictionary_hash(dictionary: bytes) -> int:
    return int.from_bytes(hashlib.sha256(dictionary).digest()[:8], "little") if dictionary else 0


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int = 0) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample."""
    chosen = (
        docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row of an id that repeats
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, "bytes")
        for b in batches:
            ids = [(x + end)[: 4 * SAMPLE_IDS] for x in enc.ids(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = texts.mapInArrow(run, "doc_id long, ids binary").collect()
    samples = [bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def file_bytes(doc_ids: list[int | None], arrays: list[bytes], dictionary: bytes) -> bytes:
    """One whole file for the given documents, each a run of little-endian 32-bit ids."""
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_dict_id=False).compress
    frames = [compress(a) for a in arrays]
    return _assemble(doc_ids, [len(a) // 4 for a in arrays], frames, dictionary)


def _assemble(doc_ids: list[int | None], sizes: list[int], frames: list[bytes], dictionary: bytes) -> bytes:
    index = np.zeros(len(frames), dtype=_INDEX)
    index["doc_id"] = [d or 0 for d in doc_ids]
    index["has_id"] = [d is not None for d in doc_ids]
    index["n"] = sizes
    index["end"] = np.cumsum([len(f) for f in frames])
    head = _MAGIC + struct.pack("<QI", dictionary_hash(dictionary), len(frames))
    return head + index.tobytes() + b"".join(frames)


def read_document(content: bytes, i: int, dictionary: bytes) -> tuple[int | None, bytes]:
    """The id and the ids of document ``i`` of a file, touching only its own bytes."""
    index, body = _opened(content, dictionary)
    start = int(index["end"][i - 1]) if i else 0
    frame = content[body + start : body + int(index["end"][i])]
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    ids = zstandard.ZstdDecompressor(dict_data=given).decompress(frame)
    return (int(index["doc_id"][i]) if index["has_id"][i] else None), ids


def _opened(content: bytes, dictionary: bytes) -> tuple[np.ndarray, int]:
    head = len(_MAGIC) + 12
    if content[:4] != _MAGIC:
        raise ValueError("not a file of ids")
    used, n = struct.unpack("<QI", content[4:head])
    if used != dictionary_hash(dictionary):
        raise ValueError("the file was written with another dictionary")
    return np.frombuffer(content, dtype=_INDEX, count=n, offset=head), head + n * _INDEX.itemsize


def _put(path: str, content: bytes) -> None:
    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if system.type_name == "local":
        place = place.replace("//", "/")
    folder, name = place.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    own = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(content)
    system.move(own, place)


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0) -> tuple[DataFrame, bytes]:
    """Write all documents under ``path``; returns (file_no, docs, ids) per file, and the dictionary."""
    dictionary = train_dictionary(docs, vocabulary, end_id)
    _put(f"{path}/dictionary.zdict", dictionary)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, "bytes")
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_dict_id=False).compress
        number = TaskContext.get().partitionId() * _PER_TASK
        ids, sizes, frames, held, written = [], [], [], 0, []

        def close():
            nonlocal ids, sizes, frames, held
            no = number + len(written)
            _put(f"{path}/{no:020d}.ids", _assemble(ids, sizes, frames, dictionary))
            written.append((no, len(ids), sum(sizes)))
            ids, sizes, frames, held = [], [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                array = enc.ids([text])[0] + end
                frame = compress(array)
                ids.append(doc_id)
                sizes.append(len(array) // 4)
                frames.append(frame)
                held += len(frame)
                if held >= FILE_BYTES:
                    close()
        if ids:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w[i] for w in written], pa.int64()) for i in range(3)], names=["file_no", "docs", "ids"]
        )

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, "file_no long, docs long, ids long"), "id-files"), dictionary


def read_ids(spark: SparkSession, path: str, dictionary: bytes) -> DataFrame:
    """Every document of the files under ``path``: file_no, nth, doc_id, before (ids ahead in its file), n_tokens, ids."""
    out = "file_no long, nth long, doc_id long, before long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        expand = zstandard.ZstdDecompressor(dict_data=given).decompress
        for batch in batches:
            for no, content in zip(batch.column("file_no").to_pylist(), batch.column("content")):
                content = content.as_buffer().to_pybytes()
                index, body = _opened(content, dictionary)
                ends = index["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                before = np.cumsum(index["n"].astype(np.int64)) - index["n"]
                for i in range(0, len(index), 512):
                    own = slice(i, i + 512)
                    n = len(index[own])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([no] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()),
                            pa.array(index["doc_id"][own], pa.int64(), mask=index["has_id"][own] == 0),
                            pa.array(before[own], pa.int64()), pa.array(index["n"][own].astype(np.int64), pa.int64()),
                            pa.array([expand(content[body + a : body + b]) for a, b in zip(starts[own], ends[own])], pa.binary()),
                        ],
                        names=[c.split()[0] for c in out.split(", ")],
                    )

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path)
        .select(F.regexp_extract("path", r"(\d+)\.ids$", 1).cast("long").alias("file_no"), "content")
    )
    return files.mapInArrow(run, out)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from files just written."""
    spark = docs.sparkSession
    path = new_path(spark, "llm-ids")
    files, dictionary = write_ids(docs, vocabulary, path, end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    back = read_ids(spark, path, dictionary)
    return back.join(offsets(files, "file_no", "ids", "from"), "file_no").select(
        "doc_id", (F.col("from") + F.col("before")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
