"""Operator 10: exact top-k search by pivot-table elimination.

Every block of candidates keeps a table of distances to pivots chosen in that
block (farthest-point selection).  For a query, the largest difference between
its pivot distances and a candidate's is a lower bound of their distance, hence
``(|q|^2 + |x|^2 - bound^2) / 2`` an upper bound of their inner product.
Candidates are evaluated in descending order of that bound until it falls below
the k-th score so far; ties of the bound are still evaluated, so the stop is exact.

Queries and candidates meet block by block: candidates are dealt into blocks of
at most about ``block_rows`` rows and each query is sent once to every block, so
no task holds more than one block and one chunk of queries, and what is shuffled
is the rows plus queries x blocks.  A second step keeps the k best of the blocks'
best (at most k rows per query and block).

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite
component takes no part, nor one whose components overflow a double when scaled, nor a
row with a null id.  Scores are exact whatever their size; one beyond a long counts as
the nearest long.  Vectors of different
lengths are not compared.  Rows that repeat an id are candidates of other ids
each on its own, never of their own id; as queries they count once (the first
of the equal vectors; a different vector under the same id adds its candidates
to the same ranking).  Fewer candidates than k give fewer rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


LOW, HIGH = -(2**63), 2**63 - 1


def pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-point pivots: each next one is the row farthest from those chosen."""
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def search_block(
    query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, n_pivots: int, step: int = 512
) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best of the block; exact, ties to the smaller id.

    Components are integers held in float64.  Where sums could reach 2^53 they are taken
    in integers of any length, and bounds on vectors scaled down by a power of two.
    """
    top = max(float(np.abs(x).max(initial=1)), float(np.abs(q).max(initial=1)))
    small = np.log2(x.shape[1]) + 2 * np.log2(top) < 52.9
    whole_x, whole_q, unit = x, q, Fraction(1)
    if not small:
        shift = int(np.frexp(top)[1]) - 20
        x, q, unit = np.ldexp(x, -shift), np.ldexp(q, -shift), Fraction(2) ** (-2 * shift)
        whole_q = [[int(v) for v in row] for row in whole_q]
    least = float(LOW * unit)
    p = pivots(x, n_pivots)
    table, asked = distances(x, p), distances(q, p)
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    # sqrt and matmul round; a slack of 1e-6 of the norms keeps the bound an upper bound
    slack = 1e-6 * (1 + float(xx.max()))
    found = []
    for i in range(len(q)):
        low = np.abs(table - asked[i]).max(1)
        bound = (qq[i] + xx - low * low) / 2 + slack + 1e-6 * qq[i]
        bound[ids == query_ids[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[int, int]] = []  # (-score, id), ascending
        at = 0
        while at < len(order) and bound[order[at]] > -np.inf and (len(best) < k or max(bound[order[at]], least) >= float(-best[-1][0] * unit)):
            rows = order[at : at + step]
            rows = rows[bound[rows] > -np.inf]
            if small:
                s = -(x[rows] @ q[i])
                near = np.lexsort((ids[rows], s))[:k]
                new = [(int(a), int(b)) for a, b in zip(s[near], ids[rows][near], strict=True)]
            else:
                new = [(-max(LOW, min(HIGH, sum(int(a) * b for a, b in zip(whole_x[r], whole_q[i], strict=True)))), int(ids[r])) for r in rows]
            best, at = sorted(best + new)[:k], at + step
        found += [(int(query_ids[i]), d, -s) for s, d in best]
    return found


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    n_pivots: int = 32,
    block_rows: int = 16384,
    query_rows: int = 2048,
) -> DataFrame:
    """The k highest inner products of each query's vector floor(scale * x) with all other rows."""
    sane = F.col("v").isNotNull() & (F.size("v") > 0)
    sane &= ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e * scale) == float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
        .where(F.col("id").isNotNull() & sane)
        .select("id", F.transform("v", lambda e: e * scale).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks"))
    )
    n, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_blocks, n_chunks = max(1, -(-n // block_rows)), max(1, -(-n_asks // query_rows))
    dim = F.size("v").alias("dim")
    block = F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_chunks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    given = rows.select(dim, block.alias("block"), every(n_chunks).alias("chunk"), "id", "v")
    asked = rows.where("asks").dropDuplicates(["id", "v"]).select(dim, every(n_blocks).alias("block"), chunk.alias("chunk"), "id", "v")
    keys = ["dim", "block", "chunk"]
    best = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_searcher(k, n_pivots), "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, n_pivots: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t.column("id").to_numpy(), np.floor(flat.reshape(t.num_rows, -1).astype(np.float64))

    def search(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = search_block(*matrix(asked), *matrix(given), k, n_pivots) if asked.num_rows and given.num_rows else []
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return search


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, unnest(x) AS e, unnest(range(len(x))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.e * c.e) AS BIGINT) AS score
      FROM u q JOIN u c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
