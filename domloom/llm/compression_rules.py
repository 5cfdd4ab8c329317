"""Operator 4: quality rules from zstandard compression bands.

A text is compressed whole and, if longer than a chunk, in fixed chunks and what
is left at its end; the ratio compressed / raw bytes must stay inside a band that
depends on the length of what is compressed.  Text below the band is repetitive,
text above it is incompressible (random symbols, encoded binary).  Short texts
compress badly whatever they hold, so the bands widen as the length falls.  A
document fails by its chunks if those outside their bands hold more than
``BAD_CHUNK_SHARE`` of its bytes.

One pass of Arrow batches, no shuffle; a task holds one block of documents.

Defined cases: null text is the empty text; an empty text has no words, so it
fails the base rule; its ratio is null.  Extra columns are ignored; repeated rows
and null ids give a row each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import textbytes as tb
from .common import documents

#: From so many UTF-8 bytes on: lowest and highest ratio of a whole text.
BANDS = ((0, 0.0, 2.0), (256, 0.18, 0.95), (1024, 0.14, 0.80), (4096, 0.10, 0.70), (16384, 0.07, 0.65))
CHUNK = 4096
#: The same for a chunk: the last is of one chunk's bytes.
CHUNK_BANDS = ((0, 0.0, 2.0), (256, 0.14, 1.00), (1024, 0.12, 0.85), (4096, 0.10, 0.75))
BAD_CHUNK_SHARE = 0.5
LEVEL = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def band(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float]:
    return bands[bisect_right(bands, n_bytes, key=lambda b: b[0]) - 1][1:]


def ratios(raw: bytes, compress) -> tuple[float | None, list[tuple[int, float]]]:
    """Ratio of the whole text, and bytes and ratio of each chunk of a text longer than one."""
    if not raw:
        return None, []
    whole = len(compress(raw)) / len(raw)
    if len(raw) <= CHUNK:
        return whole, []
    chunks = (raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))
    return whole, [(len(c), len(compress(c)) / len(c)) for c in chunks]


def outside(n_bytes: int, ratio: float, bands: tuple = BANDS) -> bool:
    low, high = band(n_bytes, bands)
    return not low <= ratio <= high


def duplicate_lines(block: tb.Block) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line of it."""
    newline = np.flatnonzero(block.data == 10)
    starts = np.unique(np.concatenate((block.offsets[:-1], newline + 1)))
    starts = starts[starts < len(block.data)]
    if not len(starts):
        return np.zeros(len(block), np.int64)
    ends = np.append(starts[1:], len(block.data))
    ends = ends - (block.data[ends - 1] == 10)
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    h = tb.span_hashes(block.data, starts, ends)
    _, distinct = tb.grouped_unique(doc, h, len(block))
    return np.bincount(doc, minlength=len(block)) - np.diff(distinct)


def repeated_words(block: tb.Block) -> np.ndarray:
    """Per document, the words inside 3-word windows that it holds twice or more."""
    h, doc = block.hashes(lower=False), block.doc_of_word()
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        w = tb.mix(tb.mix(h[at] + doc[at].astype(np.uint64)) + h[at + 1])
        w = tb.mix(w * np.uint64(5) + h[at + 2])
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        hit = np.zeros(len(w), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        for k in range(3):
            covered[at[hit] + k] = 1
    total = np.concatenate(([0], np.cumsum(covered[:-1])))
    return total[block.word_offsets[1:]] - total[block.word_offsets[:-1]]


def word_chars(block: tb.Block) -> np.ndarray:
    inside = tb._LEAD & ~tb._SEP
    return block.count(inside)


def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        for block in tb.blocks(batch.column("text")):
            n = len(block)
            words, repeats = block.n_words(), repeated_words(block)
            failed = (words < 50) | (100 * repeats > 50 * words)
            kept, ratio, chunks, bad = ~failed, [], np.zeros(n, np.int64), np.zeros(n, np.int64)
            for d in range(n):
                raw = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes()
                whole, each = ratios(raw, compress)
                ratio.append(whole)
                wrong = [size for size, r in each if outside(size, r, CHUNK_BANDS)]
                chunks[d], bad[d] = len(each), len(wrong)
                if whole is not None and outside(len(raw), whole) or sum(wrong) > BAD_CHUNK_SHARE * len(raw):
                    kept[d] = False
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").slice(block.first, n).cast(pa.int64()),
                    "n_words": pa.array(words, pa.int64()),
                    "word_chars": pa.array(word_chars(block), pa.int64()),
                    "n_symbols": pa.array(block.count(_SYMBOL), pa.int64()),
                    "n_dup_lines": pa.array(duplicate_lines(block), pa.int64()),
                    "n_repeat_words": pa.array(repeats, pa.int64()),
                    "base_failed": pa.array(failed),
                    "kept": pa.array(kept),
                    "ratio": pa.array(ratio, pa.float64()),
                    "n_chunks": pa.array(chunks),
                    "n_bad_chunks": pa.array(bad),
                }
            )


def compression_rules(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(score_batches, SCHEMA)


def op4_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(documents(spark, sf_dir))
