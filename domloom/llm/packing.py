"""Operator 9: packing by power-of-two decomposition.

A document of n ids is cut into pieces of 2048 ids and, of the rest, one piece
for each binary digit, longest first.  Pieces of one length form a bucket, and a
sequence is one piece: its length is a power of two, so it needs no padding and
never crosses documents.  Sequences are numbered bucket by bucket, longest first,
inside a bucket by scan partition and place.

One pass of Arrow batches writes the pieces (no text is shuffled); the counts per
partition and bucket - twelve rows a partition at most - give each its first number.

Defined cases: null and empty texts hold only the end id, one piece of length 1;
repeated rows and null ids are packed each on its own.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents, stage
from .tokens import encoder, tokenizer_path

LENGTH = 2048


def piece_lengths(n: int, longest: int = LENGTH) -> list[int]:
    """Descending powers of two with sum n, the longest as often as it fits."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def _packer(path: str, end_id: int, longest: int, with_ids: bool) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, used = encoder(path, end_id), TaskContext.get().partitionId(), dict.fromkeys((1 << b for b in range(longest.bit_length())), 0)
        wide = 2 if len(words.closes) <= 1 << 16 else 4
        for batch in batches:
            for block in tb.blocks(batch.column("text"), 1 << 21):
                ids, offsets = words.encode(block)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                doc, start, length, crc, place, bounds = [], [], [], [], [], []
                for d in range(len(block)):
                    at = begin = int(offsets[d])
                    for n in piece_lengths(int(offsets[d + 1]) - begin, longest):
                        doc.append(d)
                        start.append(at - begin)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                        place.append(used[n])
                        bounds.append(at)
                        used[n] += 1
                        at += n
                row = {
                    "doc_id": batch.column("doc_id").slice(block.first, len(block)).cast(pa.int64()).take(pa.array(doc, pa.int64())),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(np.diff(offsets)[doc], pa.int64()),
                    "part": pa.array(np.full(len(doc), part), pa.int32()),
                    "place": pa.array(place, pa.int64()),
                }
                if with_ids:
                    raw = memoryview(ids.astype(f"<u{wide}")).cast("B")
                    row["ids"] = pa.array([bytes(raw[wide * a : wide * (a + n)]) for a, n in zip(bounds, length, strict=True)], pa.binary())
                yield pa.record_batch(row)

    return pack


def pack(docs: DataFrame, *, path: str | None = None, end_id: int = 1, longest: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids, little-endian and unsigned, of 2 bytes if the vocabulary fits, else of 4."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long" + ", ids binary" * with_ids
    pieces = stage(docs.select("doc_id", "text").mapInArrow(tb.tidy(_packer(path or tokenizer_path(), end_id, longest, with_ids)), schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = counts.select("length", "part", (F.sum("n").over(W.orderBy(F.desc("length"), "part")) - F.col("n")).alias("first"))
    # a written table of twelve rows a partition: its size is known before the join, so the pieces are shuffled only if it is too large to send
    numbered = pieces.join(stage(first, "first"), ["length", "part"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return numbered.select(*columns, *["ids"] * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
