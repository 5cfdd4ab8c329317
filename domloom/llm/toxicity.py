"""Operator 8: toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed rows: one for the whole word and one for
each of its prefixes of 3 to 8 bytes (so inflected and compounded forms share
rows).  Filters of width 1, 2 and 3 run over the words, each is pooled to its
maximum over the text, and a logistic layer reads the pooled values.  Gradients
flow through the positions of the maxima only; Adam, fixed seed.

Training takes at most ``sample_rows`` labelled rows of each class, those with the
smallest hash of their id, of any length; rows go as long as those before them hold
less than ``sample_bytes`` bytes together, so the driver's memory is bounded.  Scoring
covers every whole text: per block of documents, the filters are applied once to
each distinct word and positions only gather and add.  The model (a few MB,
fixed by its parameters) is broadcast.

Thresholds are calibrated by language over all labelled training rows: scores are
counted per language in 200 bins, and the edge with the fewest errors is taken,
nearest to 0.5 among equals; a language with fewer than ``least_toxic`` toxic rows
keeps 0.5.  The language selects the threshold only; it never enters the score.

Defined cases: null and empty texts have no words, all filters pool to 0 and the
score is the bias alone, with labels they train that; null or unknown languages use 0.5; rows without
a label, or with a null one, train nothing; without both classes every score is 0.
Repeated rows are scored each; extra columns are ignored, or kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textbytes as tb
from .common import documents, fold, labels, stage

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 6, (1, 2, 3)
PREFIXES = range(3, 9)
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 26
PADS = max(WIDTHS) - 1
BINS = 200

_U = np.uint64


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals in lower case."""
    out = tb._LOWER[data]
    if len(data) > 1:
        b = data[1:]
        capital = (data[:-1] == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
        out[1:][capital] += 0x20
    return out


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of the embedding table of each word; 0 is the empty row."""
    lens = ends - starts
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = 1 + (tb.span_hashes(data, starts, ends) % _U(BUCKETS - 1)).astype(np.int32)
    h = np.zeros(len(starts), np.uint64)
    last = max(len(data) - 1, 0)
    for k in range(1, PREFIXES[-1] + 1):
        h += tb._BYTE[data[np.minimum(starts + k - 1, last)]] * tb._POW[k]
        if k in PREFIXES:
            row = 1 + (tb.mix(h + _U(k)) % _U(BUCKETS - 1)).astype(np.int32)
            out[:, k - PREFIXES[0] + 1] = np.where(lens >= k, row, 0)
    return out


def words_of(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a block: their rows, and each position's word."""
    data = lower(block.data)
    h = tb.span_hashes(data, block.starts, block.ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if not len(first):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), inverse
    return buckets_of(data, block.starts[first], block.ends[first]), inverse


def buckets_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    order = np.argsort(starts)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    out[order] = buckets(data, starts[order], ends[order])
    return out


def padded(words: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with PADS pads after each text, and the positions of its words."""
    n = np.diff(offsets)
    at = np.arange(len(words)) + np.repeat(np.arange(len(n)) * PADS, n)
    out = np.full(len(words) + PADS * len(n), pad)
    out[at] = words
    return out, at


class Model:
    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = [r.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.v = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32) - 2

    def forward(self, rows: np.ndarray, words: np.ndarray, offsets: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of the texts; with keep, what the gradients need."""
        emb = np.zeros((len(rows) + 1, DIM), np.float32)
        for j in range(rows.shape[1]):
            emb[:-1] += self.e[rows[:, j]]
        seq, at = padded(words, offsets, len(rows))
        n, some = len(offsets) - 1, np.diff(offsets) > 0
        pooled, places = np.zeros((n, len(self.v)), np.float32), []
        for i, w in enumerate(self.w):
            z = np.zeros((len(at), FILTERS), np.float32)
            for j in range(len(w)):
                z += (emb @ w[j])[seq[at + j]]
            if len(z):
                top = np.maximum.reduceat(z, offsets[:-1][some], axis=0)
                pooled[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum(top, 0)
            if keep:
                where = np.zeros((n, FILTERS), np.int64)
                for d in np.flatnonzero(some):
                    where[d] = offsets[d] + z[offsets[d] : offsets[d + 1]].argmax(0)
                places.append(where)
        return pooled @ self.v + self.c[0], (emb, seq, at, pooled, places)


def train(rows: np.ndarray, words: np.ndarray, offsets: np.ndarray, y: np.ndarray, *, epochs: int = 6, batch: int = 96, rate: float = 0.01, decay: float = 1e-5, seed: int = 1) -> Model:
    """rows: of the distinct words; words[offsets[d]:offsets[d+1]]: the words of text d."""
    model, rng = Model(seed), np.random.default_rng(seed)
    params = [model.e, *model.w, model.v, model.c]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            docs = order[a : a + batch]
            part = np.concatenate([words[offsets[d] : offsets[d + 1]] for d in docs]) if len(docs) else words[:0]
            offs = np.concatenate(([0], np.cumsum(offsets[docs + 1] - offsets[docs])))
            own, part = np.unique(part, return_inverse=True)
            logit, (emb, seq, at, pooled, places) = model.forward(rows[own], part, offs, keep=True)
            d_logit = ((1 / (1 + np.exp(-logit)) - y[docs]) / len(docs)).astype(np.float32)
            d_pool = d_logit[:, None] * model.v * (pooled > 0)
            d_emb = np.zeros_like(emb)
            d_w = [np.zeros_like(w) for w in model.w]
            for i, w in enumerate(model.w):
                d_z = d_pool[:, i * FILTERS : (i + 1) * FILTERS]
                for f in range(FILTERS):
                    live = np.flatnonzero(d_z[:, f])
                    for j in range(len(w)):
                        word = seq[at[places[i][live, f]] + j]
                        d_w[i][j, :, f] = d_z[live, f] @ emb[word]
                        np.add.at(d_emb, word, d_z[live, f][:, None] * w[j, :, f])
            d_e = np.zeros_like(model.e)
            used = np.flatnonzero(np.abs(d_emb[:-1]).sum(1))
            for j in range(rows.shape[1]):
                np.add.at(d_e, rows[own[used], j], d_emb[used])
            step += 1
            for p, g, mm, ss in zip(params, [d_e, *d_w, pooled.T @ d_logit, np.array([d_logit.sum()])], m, s, strict=True):
                g = g + decay * p
                mm += 0.1 * (g - mm)
                ss += 0.01 * (g * g - ss)
                p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)
            model.e[0] = 0
    return model


def fit(texts: pa.Array, y: np.ndarray, **options) -> Model | None:
    if len(set(y.tolist())) < 2:
        return None
    rows, words, lens, known = [], [], [], 0
    for block in tb.blocks(texts):
        r, inverse = words_of(block)
        rows.append(r)
        words.append(inverse + known)
        lens.append(block.n_words())
        known += len(r)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(lens))))
    return train(np.concatenate(rows), np.concatenate(words), offsets, y.astype(np.float32), **options)


def scores(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    out = [np.zeros(0)]
    for block in tb.blocks(column):
        rows, words = words_of(block)
        logit, _ = model.forward(rows, words, block.word_offsets)
        out.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -700, 700))))
    return np.concatenate(out)


def learn(docs: DataFrame, trains: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model from (doc_id, label) rows that may be learned from."""
    held = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    marked = trains.select("doc_id", "label").join(held, "doc_id", "left_semi")
    chosen = [marked.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    chosen = stage(chosen[0].unionAll(chosen[1]), "sample-ids")
    # at most 2 x sample_rows ids are broadcast; of a repeated id the first text counts
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = stage(texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id"), "sample")
    order = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    before = texts.select("doc_id", "label", F.octet_length("text").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = before.where(F.col("before") < sample_bytes).select("doc_id", "label").distinct()
    both = texts.join(F.broadcast(fits), ["doc_id", "label"], "left_semi").orderBy("label", F.xxhash64("doc_id"), "doc_id").select("text", "label").toArrow()
    model = fit(both.column("text").combine_chunks(), both.column("label").to_numpy().astype(np.int64))
    del both
    tb.release()
    return model


def score_all(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and the score of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*[docs.schema[c] for c in keep], StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(sent.value, batch.column("text")), pa.float64())
            yield pa.record_batch([*[batch.column(c) for c in keep], found], [*keep, "score"])

    return docs.mapInArrow(tb.tidy(score), schema)


def thresholds(scored: DataFrame, trains: DataFrame, *, least_toxic: int = 20) -> DataFrame:
    """(lang, threshold) with the fewest errors over all labelled training rows."""
    at = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    known = scored.where(F.col("lang").isNotNull()).join(trains.where(F.col("doc_id").isNotNull()).select("doc_id", "label"), "doc_id")
    counts = known.groupBy("lang", at.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
    up, whole = W.partitionBy("lang").orderBy("bin"), W.partitionBy("lang")
    # rejecting from the bin's lower edge on: toxic rows below it and clean rows from it on are wrong
    below = F.sum("toxic").over(up) - F.col("toxic")
    above = F.sum("clean").over(whole) - (F.sum("clean").over(up) - F.col("clean"))
    edge = F.col("bin") / BINS
    # an edge means what any edge down to the next occupied bin below means: move it towards 0.5 inside that gap
    lowest = F.coalesce((F.lag("bin").over(up) + 1) / BINS, F.lit(0.0))
    edged = counts.withColumn("edge", F.greatest(lowest, F.least(edge, F.lit(0.5)))).withColumn("wrong", below + above).withColumn("all_toxic", F.sum("toxic").over(whole))
    best = edged.groupBy("lang").agg(F.min_by("edge", F.struct("wrong", F.abs(F.col("edge") - 0.5))).alias("edge"), F.max("all_toxic").alias("n"))
    return best.select("lang", F.when(F.col("n") >= least_toxic, F.greatest("edge", F.lit(0.05))).otherwise(0.5).alias("threshold"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where((fold("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"))


def _judged(scored: DataFrame, trains: DataFrame, doc_id: str = "doc_id", lang: str = "lang", score: str = "score") -> DataFrame:
    """(lang, threshold) for the scored rows: one row a language that has labels.

    A written table: its size is known before the join, so the rows are shuffled only if it is too large to send.
    """
    return stage(thresholds(scored.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(score).alias("score")), trains), "thresholds")


def classify(docs: DataFrame, trains: DataFrame) -> DataFrame:
    """(doc_id, lang, score, threshold, rejected) of every row of docs."""
    read = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    scored = stage(score_all(read, learn(docs, trains), ["doc_id", "lang"]), "scores")
    joined = scored.join(_judged(scored, trains), "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return joined.withColumn("rejected", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, trains: DataFrame) -> DataFrame:
    """docs without the rows that are rejected by their language's threshold; all columns stay.

    Texts are scored once: the rows are written with their scores, and read again for the verdict.
    """
    # a struct keeps the row's other columns, so no name can clash
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    scored = stage(score_all(rows, learn(docs, trains), ["row", "text"]), "scores")
    lines = _judged(scored, trains, "row.doc_id", "row.lang").withColumnsRenamed({"lang": "t_lang"})
    kept = scored.join(lines, F.col("row.lang").cast("string") == F.col("t_lang"), "left").where(F.col("score") < F.coalesce("threshold", F.lit(0.5)))
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(documents(spark, sf_dir), training_labels(spark, sf_dir))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", predicted, "threshold", "rejected")
