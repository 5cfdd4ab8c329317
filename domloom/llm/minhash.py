"""Operator 2: near-duplicate groups by circulant MinHash.

A document's set is its distinct k-word shingles (A-Z lowered), held as 64-bit
hashes.  A first permutation of a universe of 2^20 places scatters the shingles;
a second one, shifted by 0, 1, 2, ... places, gives all signature coordinates, so
the coordinates of one shingle are a contiguous run of one table.  Bands of
``rows`` coordinates make the candidates, and every link is confirmed on the full
sets of the two texts: 100 * intersection >= 80 * union.  A pair at exactly 0.8
misses all 60 bands of 7 coordinates with a probability below 1e-6.

Groups, not pairs:

* Equal sets are one node (grouped by a set hash, with partial aggregation), so
  thousands of copies cost one node.
* Inside a bucket, nodes are first compared with one leader only; links are closed
  to components; a second round uses other leaders.  Only nodes that then still
  stand in one bucket in different components are compared with each other - there
  a pair decides whether two components meet.
* Of those, buckets of at most 24 nodes give pairs (at most 12 a node and bucket).
  Larger ones, closed to groups over shared nodes, are compared in blocks: nodes of
  a group are dealt by size class, since only adjacent classes can reach the
  similarity, into blocks of 128 to 2048 nodes, and a task compares two blocks by an
  inverted index and gives only the links that join components there, fewer than
  its nodes.  No bucket emits its pairs.
* Components come from alternating large-star and small-star steps over the
  links, each step a written table.

What is shuffled: 16 bytes per node and band, twice; and the texts of nodes that
share a bucket with another.  Hot buckets, leaders, hubs and copies sit in equi-joins
of shuffled tables, which adaptive execution can split.

Defined cases: fewer words than k make one shingle of the whole sequence; a null,
empty or blank text has an empty set, is linked with nothing and is kept; rows
that repeat an id are grouped each by its own text and share no link for that (and
``drop_near_duplicates`` judges each by its text); a null doc_id keeps a null component
and takes part in no group.  Extra columns are
ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import WORD, documents, shared_folder, stage

BANDS, ROWS = 60, 7
UNIVERSE = 1 << 20
FEW = 24
#: Shingles in a block of nodes (a node at least).
BLOCK_SHINGLES = 1 << 21
_U = np.uint64


def shingle_sets(block: tb.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the block's documents, ascending in each, and their offsets."""
    h, doc, n = block.hashes(lower=True), block.doc_of_word(), block.n_words()
    at = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1]) if len(h) >= k else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value = tb.mix(value * _U(0x9E3779B97F4A7C15) + h[at + j])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = [reduce(lambda v, w: tb.mix(v * _U(0x9E3779B97F4A7C15) + w), h[block.word_offsets[d] : block.word_offsets[d + 1], None], np.full(1, n[d], np.uint64)) for d in short]
        value, doc_of = np.concatenate((value, *whole)), np.concatenate((doc[at], short))
    else:
        doc_of = doc[at]
    return tb.grouped_unique(doc_of, value, len(block))


@lru_cache(4)
def _tables(coordinates: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all runs of the shifted one (a view, not a copy)."""
    rng = np.random.default_rng(seed)
    scatter, shifted = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.uint32)
    round_ = np.concatenate((shifted, shifted[:coordinates]))
    return scatter, np.lib.stride_tricks.sliding_window_view(round_, coordinates)


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int, step: int = 2048) -> np.ndarray:
    """One row of coordinates per non-empty set, in order."""
    scatter, runs = _tables(coordinates)
    place = scatter[(values & _U(UNIVERSE - 1)).astype(np.int64)]
    heads = offsets[:-1][np.diff(offsets) > 0]
    out = np.full((len(heads), coordinates), UNIVERSE, np.uint32)
    set_of = np.searchsorted(heads, np.arange(len(place)), "right") - 1
    for a in range(0, len(place), step):
        of = set_of[a : a + step]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        low = np.minimum.reduceat(runs[place[a : a + step]], first, axis=0)
        out[of[first]] = np.minimum(out[of[first]], low)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    acc = np.zeros(cells.shape[:2], np.uint64)
    for r in range(rows):
        acc = acc * _U(0x100000001B3) + cells[:, :, r] + _U(1)
    return tb.mix(acc + np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """An order-free 64-bit hash of each set; 0 for an empty one."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    if len(values):
        out[n > 0] = np.add.reduceat(tb.mix(values ^ _U(0xA5A5A5A5A5A5A5A5)), offsets[:-1][n > 0])
    return tb.mix(out + n.astype(np.uint64))


def _describe(k: int, bands: int, rows: int) -> Callable:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                values, offsets = shingle_sets(block, k)
                n = np.diff(offsets)
                hashes = band_hashes(signatures(values, offsets, bands * rows), bands, rows).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(block.first, len(block)).cast(pa.int64()),
                        "text_key": batch.column("text_key").slice(block.first, len(block)),
                        "n_shingles": pa.array(n, pa.int64()),
                        "node": pa.array(set_hashes(values, offsets).view(np.int64)),
                        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.reshape(-1))),
                    }
                )

    return describe


def _confirm(k: int, percent: int) -> Callable:
    def sets(batch: pa.RecordBatch, text: str) -> tuple[list[np.ndarray], np.ndarray]:
        each, hashes = [], [np.zeros(0, np.uint64)]
        for block in tb.blocks(batch.column(text)):
            values, offsets = shingle_sets(block, k)
            each += np.split(values, offsets[1:-1])
            hashes.append(set_hashes(values, offsets))
        return each, np.concatenate(hashes).view(np.int64)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                (a, ha), (b, hb) = sets(batch, "text_a"), sets(batch, "text_b")
                # a repeated id can bring another text: it is not the node's
                right = (ha == batch.column("a").to_numpy()) & (hb == batch.column("b").to_numpy())
                keep = np.zeros(batch.num_rows, bool)
                for i in np.flatnonzero(right):
                    common = len(np.intersect1d(a[i], b[i], assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(a[i]) + len(b[i]) - common)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return confirm


def meeting(first: list, second: list | None, percent: int) -> list[tuple[int, int]]:
    """Links that join components: items are (node, root, set); second None compares first with itself.

    Of the links between two components one is given, none inside a component.
    """
    other = first if second is None else second
    rows, values = np.repeat(np.arange(len(other)), [len(x[2]) for x in other]), np.concatenate([x[2] for x in other])
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    sizes = np.array([len(x[2]) for x in other])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    for i, (node, root, own) in enumerate(first):
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = high - low
        hits = rows[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(other))
        for j in np.flatnonzero(100 * common >= percent * (sizes + len(own) - common)).tolist():
            if (second is not None or j > i) and (a := top(root)) != (b := top(other[j][1])):
                parent[a] = b
                links.append((node, other[j][0]))
    return links


def _meet(k: int, percent: int) -> Callable:
    def meet(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = [], []
        role, node, root = (table.column(c).to_pylist() for c in ("role", "node", "root"))
        at = 0
        for block in tb.blocks(table.column("text").combine_chunks()):
            values, offsets = shingle_sets(block, k)
            for d, h in enumerate(set_hashes(values, offsets).view(np.int64).tolist()):
                if h == node[at]:  # a repeated id can bring another text: it is not the node's
                    sides[role[at]].append((node[at], root[at], values[offsets[d] : offsets[d + 1]]))
                at += 1
        alone = not any(role)
        links = meeting(sides[0], None if alone else sides[1], percent) if sides[0] and (alone or sides[1]) else []
        return pa.table([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])

    return meet


def connected(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) of every node with a link (a, b): root is the least node reachable."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0", folder)
    seen, k = None, 0
    measure = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
    while (now := measure(edges)) != seen:
        seen, k = now, k + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a written table, not an aggregate that lies where the join wants it: so adaptive execution can split a hub
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}l", folder)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = stage(large, f"{name}-{k}a", folder)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), f"{name}-{k}b", folder)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _in_blocks(nodes: DataFrame, texts: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """Links between components among the nodes (node, root, n, g) of each group g, block against block."""
    step = float(np.log(100 / percent)) * (1 + 1e-9)  # sizes that can match lie in one class or in neighbours
    nodes = nodes.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    per_class = nodes.groupBy("g", "c").agg(F.count("*").alias("m"))
    largest = F.exp((F.col("c") + 1) * step)
    fill = F.greatest(F.lit(1.0), F.least(F.greatest(F.col("m") / 16, F.lit(128.0)), F.lit(2048.0), BLOCK_SHINGLES / largest))
    per_class = stage(per_class.select("g", "c", F.ceil(F.col("m") / fill).cast("int").alias("blocks")), "classes", folder)
    nodes = stage(nodes.join(per_class, ["g", "c"]).withColumn("h", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")), "dealt", folder)
    # block h meets itself and the later ones of its class, and all of the next class
    over = per_class.select("g", (F.col("c") - 1).alias("c"), F.col("blocks").alias("above"))
    under = per_class.select("g", (F.col("c") + 1).alias("c"), F.col("blocks").alias("below"))
    known = nodes.join(over, ["g", "c"], "left").join(under, ["g", "c"], "left").select("node", "root", "g", "c", "h", "blocks", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    meets = lambda c, h, d, i, role: F.struct(c.alias("c1"), h.alias("h1"), d.alias("c2"), i.alias("h2"), F.lit(role).alias("role"))
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    c, h = F.col("c"), F.col("h")
    places = F.concat(
        F.transform(F.sequence(h, F.col("blocks") - 1), lambda i: meets(c, h, c, i, 0)),
        F.transform(to(h), lambda i: meets(c, i, c, h, 1)),
        F.transform(to(F.col("above")), lambda i: meets(c, h, c + 1, i, 0)),
        F.transform(to(F.col("below")), lambda i: meets(c - 1, i, c, h, 1)),
    )
    dealt = known.select("node", "root", "g", F.explode(places).alias("p")).select("node", "root", "g", "p.*").join(texts, "node")
    met = dealt.groupBy("g", "c1", "h1", "c2", "h2").applyInArrow(_meet(k, percent), "a long, b long")
    return stage(met, "links-blocks", folder)


def _the_rest(left: DataFrame, asked: list[DataFrame], fits, links: Callable, texts: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """Links among nodes (bucket, node, root, n) of one bucket that still stand in different components."""
    sized = left.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("head"))
    left = stage(left.join(sized, "bucket"), "left-sized", folder)
    x, y = (left.where(F.col("m") <= FEW).select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n")]) for s in "ab")
    rest = x.join(y, "bucket").where("root_a < root_b").where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    for before in asked:
        rest = rest.join(before.select("a", "b"), ["a", "b"], "left_anti")
    found = links(stage(rest, "asked-3", folder), "links-3")
    many = left.where(F.col("m") > FEW)
    if many.isEmpty():
        return found
    group = connected(many.select(F.col("head").alias("a"), F.col("node").alias("b")).where("a <> b"), folder, "groups").select("node", F.col("root").alias("g"))
    return found.unionAll(_in_blocks(many.select("node", "root", "n").distinct().join(group, "node"), texts, k, percent, folder))


def _roots(docs: DataFrame, nodes: DataFrame, members: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """(node, root) of the nodes that link to another; members: (bucket, node, leader)."""
    some = members.select("node").distinct()
    texts = stage(docs.select("doc_id", "text").join(nodes.join(some, "node", "left_semi").select("node", "doc_id"), "doc_id").select("node", "text"), "texts", folder)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        # both tables are written ones, so adaptive execution can split a hot leader's followers
        return stage(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(tb.tidy(_confirm(k, percent)), "a long, b long"), name, folder)

    # first round: everyone against the least node of the bucket
    asked = stage(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "asked-1", folder)
    found = links(asked, "links-1")
    roots = connected(found, folder, "round-1")

    def unsettled(roots: DataFrame, name: str) -> DataFrame:
        """Members of buckets that hold several components."""
        placed = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = stage(placed, f"{name}-placed", folder)
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        return stage(placed.join(mixed, "bucket", "left_semi").join(nodes.select("node", "n"), "node"), name, folder)

    left = unsettled(roots, "left-1")
    if not left.isEmpty():
        # second round: another leader in every bucket; a pair below the size ratio cannot reach the similarity
        fits = F.lit(percent) * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")
        other = left.groupBy("bucket").agg(F.min_by(F.struct("node", "root", "n"), F.xxhash64("node", "bucket")).alias("l"))
        led = left.join(other, "bucket").where("root <> l.root").select("node", F.col("l.node").alias("leader"), F.col("n").alias("n_a"), F.col("l.n").alias("n_b")).where(fits)
        pair = [F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")]
        again = stage(led.select(*pair).distinct().join(asked.select("a", "b"), ["a", "b"], "left_anti"), "asked-2", folder)
        more = links(again, "links-2")
        if not more.isEmpty():
            found = found.unionAll(more)
            roots = connected(found, folder, "round-2")
            left = unsettled(roots, "left-2")
        found = found.unionAll(_the_rest(left, [asked, again], fits, links, texts, k, percent, folder))
        roots = connected(found, folder, "round-3")
    return roots


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, root (of the row's group, not for rows without words or id) and component_id of every row."""
    folder = shared_folder(docs.sparkSession)
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    described = read.mapInArrow(tb.tidy(_describe(k, bands, rows)), "doc_id long, text_key long, n_shingles long, node long, bands array<long>")
    table = stage(described, "sets", folder)
    filled = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = stage(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")), "nodes", folder)
    banded = filled.join(nodes.select("node", "doc_id"), ["node", "doc_id"], "left_semi").select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("bucket", "leader")
    members = stage(banded.join(shared, "bucket").distinct(), "members", folder)
    if members.isEmpty():  # no two sets are alike
        component = nodes.select("node", F.col("node").alias("root"), F.col("doc_id").alias("component"))
    else:
        roots = _roots(docs, nodes, members, k, percent, folder)
        least = nodes.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        known = nodes.select("node", "doc_id").join(roots.join(least, "root"), "node", "left")
        component = known.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "doc_id").alias("component"))
    component = stage(component, "components", folder)  # written, so that many copies of one text can be split
    out = table.select("doc_id", "text_key", "n_shingles", "node").join(component, "node", "left")
    linked = F.col("n_shingles") > 0
    own = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    has_id = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_key", "n_shingles", F.when(linked & has_id, F.col("root")).alias("root"), F.when(has_id, own).alias("component_id"))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    out = _grouped(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each group: of its smallest id, and of that id's texts in the group the one of least hash.

    Rows without words or without an id are in no group and stay.
    """
    # written, since two plans read it
    verdict = stage(_grouped(docs, k, percent, bands, rows).select("doc_id", "text_key", "root"), "verdict")
    first = verdict.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.*")
    lone = verdict.where("root IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_key")
    stays = first.unionAll(lone).distinct().withColumnsRenamed({"doc_id": "m_doc", "text_key": "m_key"})
    # the row travels as one struct, so no name of its columns can clash
    row = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("m_row"), F.col("doc_id").alias("m_doc"), F.xxhash64("text").alias("m_key"))
    kept = row.join(stays, ["m_doc", "m_key"], "left_semi")
    if not verdict.where("root IS NOT NULL").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        worded = F.coalesce(F.rlike("m_row.text", F.lit(WORD)), F.lit(False))
        kept = kept.where(worded).dropDuplicates(["m_doc", "m_key"]).unionByName(kept.where(~worded))
    return kept.select("m_row.*").unionByName(docs.where("doc_id IS NULL"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""
