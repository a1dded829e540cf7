"""Token ids as length-delimited binary records with a separate offset index.

Record file, little-endian, records back to back::

    u64 payload length | u32 masked CRC of those 8 bytes | payload | u32 masked CRC of the payload
    payload = i64 doc_id | u8 doc_id present | u8 bytes per id (2 or 4) | ids

The mask is the usual rotate-and-add, ``((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32``,
over CRC-32. Shards are ranges of ascending doc_id. The index is a Parquet table with one
row per record (doc_id, shard, file, byte_offset, byte_length, n_tokens, start_in_shard),
so a reader can fetch records in any shuffled order without scanning the files.

Every attempt of a task writes a file of its own name; only the files that the committed
index names are ever read, so retried or lost tasks cannot leave wrong records behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, ids_and_text
from .encoding import encoder, tokenizer_path

MASK_DELTA = 0xA282EAD8
HEAD, KEY, TAIL = "<QI", "<q?B", "<I"

INDEX_SCHEMA = ("doc_id long, shard int, file string, byte_offset long, byte_length long, n_tokens long, "
                "start_in_shard long")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(TAIL, masked_crc(length)), payload, struct.pack(TAIL, masked_crc(payload))))


def serialize(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return struct.pack(KEY, doc_id or 0, doc_id is not None, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, present, width = struct.unpack_from(KEY, payload)
    return doc_id if present else None, np.frombuffer(payload, "<u4" if width == 4 else "<u2", offset=struct.calcsize(KEY))


def read_record(stream) -> bytes:
    """The next payload of an open record file; a broken length or checksum is an error."""
    head = stream.read(struct.calcsize(HEAD))
    if len(head) != struct.calcsize(HEAD):
        raise ValueError("record file ends inside a record header")
    length, crc = struct.unpack(HEAD, head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("record length does not match its checksum")
    payload = stream.read(length)
    tail = stream.read(struct.calcsize(TAIL))
    if len(payload) != length or len(tail) != struct.calcsize(TAIL) or struct.unpack(TAIL, tail)[0] != masked_crc(payload):
        raise ValueError("record payload does not match its checksum")
    return payload


def open_filesystem(uri: str):
    """(filesystem, path) of a folder that driver and executors share; plain paths count as file://."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def normal_uri(path: str) -> str:
    return "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode every document and write record files under ``folder`` in ascending doc_id order.

    Returns the committed index table. A null text counts as empty (one record with the end id
    alone); a null doc_id sorts first; rows that repeat a doc_id are ordered by their text. An
    empty table gives an empty index and no file. Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = normal_uri(folder)

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_filesystem(folder)
        enc = encoder(tokenizer)
        wide = max(enc.vocab_size, end_id + 1) > 1 << 16
        end = struct.pack("<I", end_id)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        out, offset, start = None, 0, 0
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(enc.encode_bytes(text) + end, "<u4")
                    record = frame(serialize(doc_id, ids, wide))
                    if out is None:
                        fs.create_dir(f"{base}/records", recursive=True)
                        out = fs.open_output_stream(f"{base}/records/{name}")
                    out.write(record)
                    rows.append((doc_id, offset, len(record), len(ids), start))
                    offset += len(record)
                    start += len(ids)
                if rows:
                    ids_, off, size, n, first = zip(*rows)
                    yield pa.record_batch({
                        "doc_id": pa.array(ids_, pa.int64()), "shard": pa.array([shard] * len(rows), pa.int32()),
                        "file": pa.array([name] * len(rows), pa.string()), "byte_offset": pa.array(off, pa.int64()),
                        "byte_length": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                        "start_in_shard": pa.array(first, pa.int64())})
        finally:
            if out is not None:
                out.close()

    ordered = ids_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write_shard, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{normal_uri(folder)}/index")


def read_token_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names (any subset, any order) and check every checksum.

    Returns doc_id, shard, start_in_shard, ids (array<int>). Rows of one file that follow each
    other are read through one open handle.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs, ids in records_of(batches, folder):
            yield pa.record_batch({
                "doc_id": pa.array(docs, pa.int64()), "shard": part.column(1), "start_in_shard": part.column(6),
                "ids": pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))})

    folder = normal_uri(folder)
    return index.select(*index_columns()).mapInArrow(
        read, "doc_id long, shard int, start_in_shard long, ids array<int>")


def index_columns() -> list[str]:
    return [c.split()[0] for c in INDEX_SCHEMA.split(", ")]


def records_of(batches, folder):
    """(index rows, doc_ids, id arrays) in slices of at most 1,024 records."""
    fs, base = open_filesystem(folder)
    opened, stream = None, None
    try:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                docs, ids = [], []
                for name, offset in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if name != opened:
                        if stream is not None:
                            stream.close()
                        opened, stream = name, fs.open_input_file(f"{base}/records/{name}")
                    if stream.tell() != offset:
                        stream.seek(offset)
                    doc_id, values = parse(read_record(stream))
                    docs.append(doc_id)
                    ids.append(values)
                yield part, docs, ids
    finally:
        if stream is not None:
            stream.close()


def record_digests(index: DataFrame, folder: str) -> DataFrame:
    """Per record, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (CRC-32 of all its ids as little-endian unsigned 32-bit integers)."""
    folder = normal_uri(folder)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs, ids in records_of(batches, folder):
            yield pa.record_batch({
                "doc_id": pa.array(docs, pa.int64()), "shard": part.column(1), "start_in_shard": part.column(6),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})

    digests = index.select(*index_columns()).mapInArrow(
        digest, "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long")
    # one row per shard: its first id's place in the whole sequence
    totals = index.groupBy(F.col("shard").alias("s")).agg(F.sum("n_tokens").alias("total"))
    before = totals.select("s", (F.sum("total").over(Window.orderBy("s")) - F.col("total")).alias("before"))
    return digests.join(before, digests["shard"] == before["s"]).select(
        "doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    index = write_token_records(documents(spark, sf_dir), folder, tokenizer_path())
    return record_digests(index, folder)
