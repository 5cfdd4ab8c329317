"""Operator 5: token ids in a byte-plane (or bit-plane) file format.

A file is one byte string:

    "DLP1" | u8 planes (1: byte, 2: bit) | u32 ids per block | u64 ids | u64 documents
    zstd(document table: i64 doc_id[], u8 known[], i64 n_tokens[])
    the planes of each block of ids, every plane a zstd frame of its own
    chunk index: for each block and plane u64 offset, u32 length
    u64 offset of the document table, u32 its length, u64 offset of the chunk index, u32 planes per block

All numbers are little-endian.  Byte plane j of a block holds byte j of each of
its ids; bit plane j holds bit j of each, eight to a byte.  The chunk index makes
a block readable without those before it.

The corpus is range-partitioned and sorted by doc_id, each partition writes its
files in order (at most ``ids_per_file`` ids beyond the last document), and the
files travel as binary rows of a Parquet table in the shared folder, so they work
on any store that Spark reaches.  ``export_files`` of such a table gives plain
files.  Starts come from the sums of partitions (a window over one row each) and
of the files inside a partition.

Defined cases: null and empty texts hold only the end id; null ids sort first;
repeated rows are encoded each, in an order fixed by id and text.  Extra columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents, stage
from .tokens import encoder, tokenizer_path

MAGIC = b"DLP1"
HEAD, FOOT = struct.Struct("<4sBIQQ"), struct.Struct("<QIQI")
BYTE, BIT = 1, 2
RANGE_BYTES = 1 << 28


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE:
        return [raw[:, j].tobytes() for j in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, j]).tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, n_tokens: np.ndarray, kind: int = BYTE, block: int = 1 << 16, level: int = 1) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    out = [HEAD.pack(MAGIC, kind, block, len(ids), len(doc_ids))]
    at, index = HEAD.size, []
    table = pack(doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + n_tokens.astype("<i8").tobytes())
    table_at, at = at, at + len(table)
    out.append(table)
    for i in range(0, len(ids), block):
        for plane in to_planes(ids[i : i + block], kind):
            out.append(pack(plane))
            index.append((at, len(out[-1])))
            at += len(out[-1])
    out += [struct.pack("<QI", *x) for x in index]
    out.append(FOOT.pack(table_at, len(table), at, 4 if kind == BYTE else 32))
    return b"".join(out)


class Reader:
    """Random access to one file's blocks; raises ValueError for what is not such a file."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        if len(raw) < HEAD.size + FOOT.size or raw[:4] != MAGIC:
            raise ValueError("not a plane file")
        _, self.kind, self.block, self.n_ids, self.n_docs = HEAD.unpack_from(raw)
        at, size, self.index, self.planes = FOOT.unpack_from(raw, len(raw) - FOOT.size)
        unpack = zstandard.ZstdDecompressor().decompress
        table, n = unpack(raw[at : at + size]), self.n_docs
        self.doc_ids = np.frombuffer(table, "<i8", n)
        self.known = np.frombuffer(table, np.uint8, n, 8 * n).astype(bool)
        self.n_tokens = np.frombuffer(table, "<i8", n, 9 * n)
        self.unpack = unpack

    def read_block(self, k: int) -> np.ndarray:
        n, planes = min(self.block, self.n_ids - k * self.block), []
        for j in range(self.planes):
            at, size = struct.unpack_from("<QI", self.raw, self.index + 12 * (k * self.planes + j))
            planes.append(self.unpack(self.raw[at : at + size]))
        return from_planes(planes, n, self.kind)

    def read(self) -> np.ndarray:
        parts = [self.read_block(k) for k in range(-(-self.n_ids // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _writer(path: str, end_id: int, kind: int, ids_per_file: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = encoder(path, end_id), TaskContext.get().partitionId(), 0
        ids, docs, known, lens, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            raw = write_file(np.concatenate(ids), np.concatenate(docs), np.concatenate(known), np.concatenate(lens), kind)
            row = {"part": [part], "seq": [seq], "n_ids": [held], "file": [raw]}
            for x in (ids, docs, known, lens):
                x.clear()
            seq, held = seq + 1, 0
            return pa.record_batch(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())]))

        for batch in batches:
            for block in tb.blocks(batch.column("text"), 3 << 20):
                new, offsets = words.encode(block)
                doc = batch.column("doc_id").slice(block.first, len(block)).cast(pa.int64())
                ids.append(new)
                docs.append(doc.fill_null(0).to_numpy(zero_copy_only=False))
                known.append(doc.is_valid().to_numpy(zero_copy_only=False))
                lens.append(np.diff(offsets))
                held += len(new)
                if held >= ids_per_file:
                    yield flush()
        if docs:
            yield flush()

    return write


def write_planes(docs: DataFrame, *, path: str | None = None, end_id: int = 2, kind: int = BYTE, ids_per_file: int = 1 << 21) -> DataFrame:
    """The table of files (part, seq, n_ids, file), kept in the shared folder."""
    # ranges of about RANGE_BYTES of text, whatever the number of shuffle partitions is
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_writer(path or tokenizer_path(), end_id, kind, ids_per_file), "part int, seq int, n_ids long, file binary")
    return stage(made, "files")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, raw in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["file"], strict=True):
            r = Reader(raw.as_py())
            ids = np.ascontiguousarray(r.read())
            ends = np.cumsum(r.n_tokens)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - r.n_tokens).tolist(), ends.tolist(), strict=True)]
            n = r.n_docs
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(n, part), pa.int32()),
                    "seq": pa.array(np.full(n, seq), pa.int32()),
                    "doc_id": pa.array(r.doc_ids, pa.int64(), mask=~r.known),
                    "inside": pa.array(ends - r.n_tokens, pa.int64()),
                    "n_tokens": pa.array(r.n_tokens, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_planes(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    files_at = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("file_start", files_at).join(parts, "part").select("part", "seq", (F.col("file_start") + F.col("part_start")).alias("base"))
    read = files.select("part", "seq", "file").mapInArrow(_read_files, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # a written table of one row a file: its size is known before the join
    return read.join(stage(starts, "starts"), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> list[str]:
    """Plain files on the driver's disk, in order; one file at a time is held."""
    names = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in files.orderBy("part", "seq").select("part", "seq", "file").toLocalIterator():
        names.append(f"{folder}/{row.part:06d}-{row.seq:06d}.dlp")
        Path(names[-1]).write_bytes(row.file)
    return names


def op5_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_planes(write_planes(documents(spark, sf_dir)))
