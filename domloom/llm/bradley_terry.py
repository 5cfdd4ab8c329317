"""Operator 1: quality scores by Bradley-Terry pairwise ranking.

Every whole text becomes a short vector of shape features (shares of character
classes, repetition, word lengths); labels, language, source and id are never
among them.  Pairs of a good and a bad training document give the logistic loss
``log(1 + exp(-w . (x_good - x_bad)))``, minimised by Newton steps with a ridge
penalty.  A document's strength is ``w . x``.

The cut is a quantile of strength: the labelled training rows, all of them, are
counted between ``QUANTILES`` quantiles of their strengths, and the quantile with the
fewest training errors is taken (the middle one of a run of equals), half way between
the two strengths that it lies between.  The score is
``sigmoid(strength - cut + logit(0.7))``, so 0.7 is the cut.

Weights are fitted on at most ``sample_rows`` labelled rows of each class, those
with the smallest hash of their id; features, strengths and the cut cover all rows.

Plan: one Arrow pass over the texts writes the features (about 100 bytes a
document) to the shared folder; what follows reads only those.

Defined cases: null counts as the empty text, whose features are all zero; a
document without a label, or with a null one, trains nothing; repeated label rows
count each; without training rows of both classes the strength is 0 and every
score 0.7.  A null doc_id gives a row with held_out null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents, fold, labels, stage
from .compression_rules import duplicate_lines, repeated_words, word_chars

CUT_SCORE = 0.7
SAMPLE_ROWS = 10_000
QUANTILES = 2000


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_CLASSES = [
    _class("#*$%&<>@^~=+_\\{}[]/"),
    _class("|"),
    _class("!?"),
    _class("0123456789"),
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class(".,;:'\"()-"),
    _class("\n"),
]
NAMES = ["length", "symbols", "pipes", "shouts", "digits", "capitals", "points", "lines", "word_length", "repeats", "dup_lines", "distinct", "spaces", "longest", "odd_ends", "stutter"]


def features(block: tb.Block) -> np.ndarray:
    n, words = len(block), block.n_words()
    size = np.maximum(block.count(tb._LEAD), 1)
    some = np.maximum(words, 1)
    shares = [np.sqrt(block.count(c) / size) for c in _CLASSES]
    chars = word_chars(block)
    doc, h = block.doc_of_word(), block.hashes(lower=True)
    _, offsets = tb.grouped_unique(doc, h, n)
    distinct = np.diff(offsets)
    lens = block.ends - block.starts
    longest = np.zeros(n)
    has = words > 0
    if len(lens):
        longest[has] = np.maximum.reduceat(lens, block.word_offsets[:-1][has])
    last = block.data[block.ends - 1] if len(lens) else np.zeros(0, np.uint8)
    odd = np.bincount(doc, weights=(_CLASSES[0] | _CLASSES[1] | _CLASSES[2])[last], minlength=n)
    lines = np.maximum(block.count(_CLASSES[6]) + 1, 1)
    out = [np.log1p(words), *shares, chars / some, repeated_words(block) / some, duplicate_lines(block) / lines]
    # distinct words against what a text of that many words tends to hold
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    stutter = np.sqrt(np.bincount(doc[again], minlength=n) / some)
    out += [np.log((1 + distinct) / (1 + words) ** 0.85), np.sqrt(1 - chars / size), np.log1p(longest), odd / some, stutter]
    x = np.stack(out, 1)
    x[~has] = 0
    return x


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch.column("text")):
            x = features(block).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(block.first, len(block)).cast(pa.int64()), "x": flat})


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares."""
    z = np.clip((x.astype(np.float64) - mean) / scale, -8, 8)
    return np.concatenate((z, z * z), 1)


def fit(good: np.ndarray, bad: np.ndarray, *, pairs: int = 60_000, ridge: float = 3.0, steps: int = 30, seed: int = 1) -> dict:
    """Weights from pairs of rows drawn with a fixed seed; every row is in some pair."""
    if not len(good) or not len(bad):
        return {"w": None}
    both = np.concatenate((good, bad)).astype(np.float64)
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    pairs = max(pairs, len(good), len(bad))
    pick = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-pairs // n))])[:pairs]
    d = expand(good, mean, scale)[pick(len(good))] - expand(bad, mean, scale)[pick(len(bad))]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return {"w": w, "mean": mean, "scale": scale}


def strength(model: dict, x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x)) if model["w"] is None else expand(x, model["mean"], model["scale"]) @ model["w"]


def cut_from_counts(bad: np.ndarray, good: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The cut between two bins, by the counts and the extremes of strength in each (nan where empty).

    Bad rows in or above a bin and good rows below it are errors; the first bin has nothing below it.
    """
    filled = np.flatnonzero(bad + good)
    bad, good, low, high = bad[filled], good[filled], low[filled], high[filled]
    wrong = np.concatenate(([0], np.cumsum(good))) + bad.sum() - np.concatenate(([0], np.cumsum(bad)))
    best = np.flatnonzero(wrong == wrong.min())
    run = best[: np.flatnonzero(np.diff(best, append=best[-1] + 2) > 1)[0] + 1]
    at = int(run[len(run) // 2])
    if at == len(low):
        return float(np.nextafter(high[-1], np.inf))
    return float(((high[at - 1] if at else low[0]) + low[at]) / 2)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scorer(model: dict) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "strength": pa.array(strength(model, _matrix(batch.column("x"))))})

    return score


def _cut(known: DataFrame) -> float:
    """The best quantile of (strength, label) rows; what reaches the driver is bounded by QUANTILES."""
    levels = [F.lit(i / QUANTILES) for i in range(1, QUANTILES)]
    edges = np.unique(known.agg(F.percentile_approx("strength", F.array(*levels), 10 * QUANTILES)).first()[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(edges, batch.column("strength").to_numpy(), "right")
            yield pa.record_batch({"bin": pa.array(at, pa.int32()), "label": batch.column("label").cast(pa.int32()), "strength": batch.column("strength")})

    counts, ends = np.zeros((2, QUANTILES), np.int64), np.full((2, QUANTILES), np.nan)
    binned = known.mapInArrow(place, "bin int, label int, strength double").groupBy("bin")
    for k, bad, good, low, high in binned.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.min("strength"), F.max("strength")).collect():
        counts[:, k], ends[:, k] = (bad, good), (low, high)
    return cut_from_counts(*counts, *ends)


def rank_quality(docs: DataFrame, trains: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, strength, score) of all docs; trains holds (doc_id, label) rows that may be learned from."""
    table = stage(docs.select("doc_id", "text").mapInArrow(feature_batches, "doc_id long, x array<float>"), "features")
    trains = trains.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", "label")
    marked = table.join(trains, "doc_id")
    sampled = {c: marked.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_rows).select("x").toArrow() for c in (0, 1)}
    x = {c: _matrix(t.column("x")) if t.num_rows else np.zeros((0, len(NAMES))) for c, t in sampled.items()}
    model = fit(x[1], x[0])
    scored = table.mapInArrow(_scorer(model), "doc_id long, strength double")
    cut = 0.0 if model["w"] is None else _cut(stage(scored.join(trains, "doc_id").select("strength", "label"), "known"))
    shifted = F.col("strength") - F.lit(float(cut)) + F.lit(float(np.log(CUT_SCORE / (1 - CUT_SCORE))))
    return scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), shifted))))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains = labels(spark, sf_dir).where(fold("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = rank_quality(documents(spark, sf_dir), trains)
    predicted = F.when(F.col("score") >= CUT_SCORE, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", predicted)
