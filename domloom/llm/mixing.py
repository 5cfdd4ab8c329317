"""Operator 7 (native): mixing sources to target weights.

Tokens are summed per source (partial sums before the shuffle), targets follow
from weights and a cap, and each document is emitted floor(rate) times plus once
more with probability rate - floor(rate), where rate = target / source size.  The
Bernoulli draw compares that fraction with the first 48 bits of
md5(seed:doc_id), so reruns and retried tasks agree and no random state is held.

Targets are the fixed point of "give by weight, stop at the cap, reshare the
excess": with sources in ascending order of cap / weight, the full ones are a
prefix, and the level of the others is what is left over the weights that are left.

Only the table of sources (one row per source) passes through a window without
partitions; documents never do.  The join back is on one row per source: Spark
broadcasts it by its measured size, or splits a hot source's rows.

Defined cases: null text has size 0; sources of size 0 have target 0 and their
documents are not emitted; null is a source of its own and the last; a null
doc_id is drawn as the text 'null'; repeated rows share one draw; extra columns,
whatever their names, pass through ``mix``.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, stage

SEED = "mix"
WEIGHTS = (3, 1, 2)


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(m_source, m_source_size, m_target) of a table with m_source and m_size."""
    per = sized.groupBy("m_source").agg(F.sum("m_size").alias("m_source_size"))
    by_name = W.orderBy(F.col("m_source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    weighed = weighed.withColumn("cap", F.col("m_source_size") * F.lit(cap))
    filling = W.orderBy(F.col("cap") / F.col("w"), F.col("m_source").asc_nulls_last())
    every = filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("m_source_size").over(every) * total - (F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("w").over(
        filling.rowsBetween(0, W.unboundedFollowing)
    )
    # the level if this source and all after it are open; the least such level over the prefix of full ones holds
    open_ = F.col("level") * F.col("w") <= F.col("cap")
    found = weighed.withColumn("level", level).withColumn("open_level", F.when(open_, F.col("level")))
    first_open = F.first("open_level", ignorenulls=True).over(every)
    share = F.coalesce(first_open, F.lit(float("inf"))) * F.col("w")
    return found.select("m_source", "m_source_size", F.least(share, F.col("cap")).alias("m_target"))


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, *, size: Column | None = None, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """m_row (the document's row), m_doc, m_size, m_source_size, m_target and m_copies of every row of docs; size: a column that holds the words of a row."""
    size = (words_in("text") if size is None else size).alias("m_size")
    # the row travels as one struct, so no name of its columns can clash
    sized = docs.select(F.struct(*docs.columns).alias("m_row"), F.col("doc_id").alias("m_doc"), F.col("source").alias("m_from"), size)
    # a written table of one row a source: its size is known before the join, so the rows are shuffled only if it is too large to send
    goal = stage(targets(docs.select(F.col("source").alias("m_source"), size), weights=weights, total=total, cap=cap), "targets")
    joined = sized.join(goal, sized["m_from"].eqNullSafe(goal["m_source"]), "left").drop("m_source", "m_from")
    rate = F.when(F.col("m_source_size") > 0, F.col("m_target") / F.col("m_source_size")).otherwise(0.0)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("m_doc").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("m_copies", copies.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as its source's rate asks for."""
    repeated = plan(docs, **options).where("m_copies > 0").select("m_row", F.explode(F.sequence(F.lit(1), F.col("m_copies"))))
    return repeated.select("m_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once
    docs = stage(documents(spark, sf_dir).select("doc_id", "source", words_in("text").alias("size")), "sizes")
    taken = (F.col("m_copies") * F.col("m_size")).alias("taken")
    return plan(docs, size=F.col("size")).select(F.col("m_doc").alias("doc_id"), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), taken)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w,
      source_size * 2.0::DOUBLE AS cap FROM per),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT min(cap / w) AS edge FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l, o WHERE cap / w = edge AND level * l.w <= cap ORDER BY source NULLS LAST LIMIT 1), 1e300) * w) AS target FROM l),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate)
  THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
