r"""Operator 3 (native): personal data, and the terms that give it away.

Base spans come from four patterns.  They are written with possessive loops and
with a guard before each start (not inside a run that was already tried, or right
after the last match), which finds the same leftmost matches in linear time and
without deep recursion on long runs.  ``split`` and ``regexp_extract_all`` of one
pattern give the gaps and the matches, and the running sum of their lengths gives
offsets in code points (summed by blocks of sqrt(n), so n matches cost n^1.5).

The method is information-theoretic sanitisation.  The values found are the
protected entities e; the other words of their documents are the terms t.  Over
the whole corpus, with n(e), n(t) and n(t, e) counted in documents,

    P(e | t) = (n(t, e) + a n(e) / N) / (n(t) + a),
    PMI(t; e) = log2(P(e | t) N / n(e)),    IC(e) = log2(N / n(e)),

and the share PMI / IC of an entity's information is what the term discloses.  The
``prior`` of a documents (one) in which the term tells nothing shrinks what small
counts say instead of leaving them out: most personal data is held by one document.  In
documents that hold e, terms that disclose ``generalise`` of it or more become spans
of kind ``term``, and those that disclose ``remove`` or more kind ``term_removed``;
``sanitise`` writes a placeholder for the first and nothing for the second.

Plan: one native pass finds the base spans and keeps the texts that have some; one more
pass counts the remaining terms of those in all documents.  Entities held by the same
documents have the same counts and are taken as one, and so are terms of one n(t) in
the same documents; sets of documents are told apart by 128 bits of hashes.

Only pairs that share two documents or more are listed.  For the others n(t, e) = 1,
and then the share falls as n(e) grows, so the least n(e) of a document speaks for all
its entities: that needs no pairs.  Of two sets that share two documents at least one
shared document is not the largest of both, so entities and terms that are both at
their largest document (by the pairs it would give) do not meet there: a directory
whose entries recur on pages of their own gives no square of its entries.  What is left
grows with the pairs of repeated entity sets and term sets that do meet elsewhere, as
in several directories with the same entries but different neighbours.  Terms too
frequent to pass for any entity are left out before all that: of those, the most
frequent by a list of at most ``HOT``, the rest by their counts.

Defined cases: null counts as the empty text; rows are told apart by doc_id and a
hash of their text, so repeated rows share their spans and count as one document,
and rows of one id with different texts do not mix; a null id takes part in base
spans only.  Where spans overlap, ``sanitise`` writes the placeholder of the first.
Extra columns, whatever their names, pass through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, shared_folder, stage

_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
ORDER = [*KINDS, "term", "term_removed"]
EDGE = ".,;:!?\"'()[]{}<>*#$%&|~"
SPAN = "array<struct<start:bigint,ord:int,end:bigint,value:string>>"
PRIOR, GENERALISE, REMOVE = 1.0, 0.85, 0.97
#: Terms that are broadcast as strings, and as hashes.
HOT, SENT = 2**17, 2**20


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), in order."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.lit(0).cast("long")
    # zipped, since what stands inside a lambda is computed for every element; the last gap has no match
    pairs = F.filter(F.arrays_zip(found, gaps), lambda z: z.getField("0").isNotNull())
    both = F.transform(pairs, lambda z: F.struct(F.length(z.getField("1")).cast("long").alias("gap"), F.length(z.getField("0")).cast("long").alias("n"), z.getField("0").alias("value")))

    def place(w: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(w)))).cast("int")
        width = lambda a: F.aggregate(a, zero, lambda s, x: s + x["gap"] + x["n"])
        sums = F.transform(F.sequence(F.lit(0), (F.size(w) / size).cast("int")), lambda b: width(F.slice(w, b * size + 1, size)))

        def with_sums(box: Column) -> Column:
            total = F.aggregate(box["sums"], F.array(zero), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

            def with_total(box: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    block = F.floor(i / size).cast("int")
                    start = F.get(box["total"], block) + width(F.slice(w, block * size + 1, i - block * size)) + x["gap"]
                    return F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value"))

                return F.transform(w, one)

            return F.element_at(F.transform(F.array(F.struct(total.alias("total"))), with_total), 1)

        return F.element_at(F.transform(F.array(F.struct(sums.alias("sums"))), with_sums), 1)

    # one-element arrays name a value once for several uses below it
    return F.element_at(F.transform(F.array(F.struct(both.alias("w"))), lambda box: place(box["w"])), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    d = _digits(value)
    return F.length(d).between(10, 15) if kind == "phone" else F.length(d).between(14, 19) & luhn(d)


def base_spans(text: Column) -> Column:
    """Sorted spans of the four kinds that pass their tests."""
    text = F.coalesce(text, F.lit(""))

    def of_kind(k: int, kind: str) -> Column:
        hint = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
        kept = F.filter(located(text, KINDS[kind]), lambda m: _holds(kind, m["value"]))
        shaped = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(hint, shaped).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)]))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in ORDER]), s["ord"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _term(word: Column) -> Column:
    return F.btrim(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(EDGE))


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("p_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("p_hash")]


def find_base(docs: DataFrame, folder: str, *, rows: bool = False) -> DataFrame:
    """p_doc, p_hash and p_base (sorted spans) of every row, p_text where it has spans; with rows also p_row, the row as a struct."""
    whole = [F.struct(*docs.columns).alias("p_row")] * rows  # one column, so no name of the row's columns can clash
    found = docs.select(*_key(docs), *whole, F.coalesce("text", F.lit("")).alias("p_text"), base_spans(F.col("text")).alias("p_base"))
    return stage(found.withColumn("p_text", F.when(F.size("p_base") > 0, F.col("p_text"))), "base", folder)


KEY = ["p_doc", "p_hash"]


def _entities(base: DataFrame, folder: str) -> DataFrame:
    """KEY, n_e and entity: a set of documents that holds some entity, for each document of the set."""
    value = F.when(F.col("s.ord") == 0, F.lower("s.value")).when(F.col("s.ord") == 1, F.col("s.value")).otherwise(_digits(F.col("s.value")))
    held = base.where("size(p_base) > 0 AND p_doc IS NOT NULL").select(*KEY, F.explode("p_base").alias("s"))
    held = held.select(*KEY, F.concat(F.col("s.ord").cast("string"), F.lit(":"), value).alias("value")).distinct()
    groups = held.groupBy("value").agg(F.count("*").alias("n_e"), *_marks())
    held = held.join(groups, "value").select(*KEY, "n_e", F.struct("n_e", "mark_1", "mark_2").alias("entity"))
    return stage(held.distinct(), "entities", folder)


def _marks() -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(k), *KEY)).alias(f"mark_{k}") for k in (1, 2)]


def _words(base: DataFrame, repeats: bool) -> DataFrame:
    """KEY, term, start and end of the words beside the spans, in documents that have spans."""
    near = base.where("size(p_base) > 0 AND p_doc IS NOT NULL").select(*KEY, "p_base", "p_text")
    near = near.dropDuplicates(KEY) if repeats else near
    words = near.select(*KEY, "p_base", F.explode(located(F.col("p_text"), WORD)).alias("w")).withColumn("term", _term(F.col("w.value")))
    begin = F.col("w.start") + F.length("w.value") - F.length(F.ltrim("w.value", F.lit(EDGE)))
    words = words.where("term <> ''").select(*KEY, "p_base", "term", begin.alias("start"), (begin + F.length("term")).alias("end"))
    return words.where(~F.exists("p_base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))).drop("p_base")


def _counts(docs: DataFrame, local: DataFrame, repeats: bool) -> DataFrame:
    """(term, n_t) over all documents, of the terms of local at least."""
    terms = F.array_distinct(F.transform(F.array_distinct(F.split(F.coalesce("text", F.lit("")), f"[{SPACE}]+")), _term))
    every = docs.where("doc_id IS NOT NULL").select(*_key(docs), F.explode(terms).alias("term"))
    if local.count() <= SENT:  # their hashes are sent; else counts of all terms meet them
        sent = F.broadcast(local.select(F.xxhash64("term").alias("h")).distinct())
        every = every.withColumn("h", F.xxhash64("term")).join(sent, "h", "left_semi")
    every = every.select(*KEY, "term").distinct() if repeats else every
    return every.groupBy("term").agg(F.count("*").alias("n_t"))


def _meetings(held: DataFrame, tdoc: DataFrame, folder: str) -> DataFrame:
    """(entity, n_e, t, n_t, n_te) of all pairs that share two documents or more."""
    held = held.where("n_e > 1").select(*KEY, "entity", "n_e")
    tdoc = tdoc.where("n_here > 1").select(*KEY, "t", "n_t")
    weight = held.groupBy(*KEY).agg(F.count("*").alias("a")).join(tdoc.groupBy(*KEY).agg(F.count("*").alias("b")), KEY)
    weight = stage(weight.select(*KEY, F.struct((F.col("a") * F.col("b")).alias("w"), *KEY).alias("place")), "places", folder)

    def with_last(rows: DataFrame, item: str, name: str) -> DataFrame:
        """Whether a row stands at the largest document of its item, and that document."""
        placed = rows.join(weight, KEY)
        last = placed.groupBy(item).agg(F.max("place").alias("last"))
        return stage(placed.join(last, item).withColumn("at_last", F.col("place") == F.col("last")).drop("place"), name, folder)

    e = with_last(held, "entity", "entity-places").withColumnsRenamed({"last": "e_last", "at_last": "e_at"})
    t = with_last(tdoc, "t", "term-places").withColumnsRenamed({"last": "t_last", "at_last": "t_at"})
    meet = e.where("NOT e_at").join(t, KEY).unionByName(e.where("e_at").join(t.where("NOT t_at"), KEY))
    found = meet.groupBy("entity", "n_e", "t", "n_t").agg(F.count("*").alias("n"), F.first(F.col("e_last") == F.col("t_last")).alias("both"))
    return found.select("entity", "n_e", "t", "n_t", (F.col("n") + F.col("both").cast("long")).alias("n_te"))


def disclosing_terms(
    docs: DataFrame, base: DataFrame, folder: str, *, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """p_doc, p_hash and p_terms (spans of disclosing terms) of the documents that hold such."""
    held = _entities(base, folder)
    n_rows, n = base.where("p_doc IS NOT NULL").agg(F.count("*"), F.count_distinct(*KEY)).first()
    size = F.lit(float(n or 1))
    held = held.where(F.col("n_e") < n)  # what every document holds tells nothing apart
    words = stage(_words(base, n_rows > n), "words", folder)

    # n(t, e) is at most n(e), so a term with a larger n(t) than this cannot pass for the entity
    most = (F.col("n_e") + prior * F.col("n_e") / size) * F.pow(size / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9) - prior
    limit = held.agg(F.max(most)).first()[0]
    if limit is None:
        return words.select(*KEY, F.array().cast(SPAN).alias("p_terms")).limit(0)
    per_doc = words.select(*KEY, "term").distinct()
    local = stage(per_doc.groupBy("term").agg(F.count("*").alias("n_here"), *_marks()), "local", folder)
    # at most HOT terms are sent; the others go by the counts below
    hot = local.where(F.col("n_here") > max(limit, words.count() / HOT)).select("term")
    words = words.join(F.broadcast(hot), "term", "left_anti")
    local = local.where(F.col("n_here") <= limit)
    counted = local.join(_counts(docs, local, n_rows > n), "term").where(F.col("n_t") <= limit)
    terms = counted.select("term", "n_t", "n_here", F.struct("n_t", "mark_1", "mark_2").alias("t"))
    words = stage(words.join(terms, "term"), "candidates", folder)
    tdoc = stage(words.select(*KEY, "t", "n_t", "n_here").distinct(), "term-sets", folder)

    def share(n_te: Column) -> Column:
        return F.log2((n_te + prior * F.col("n_e") / size) * size / ((F.col("n_t") + prior) * F.col("n_e"))) / F.log2(size / F.col("n_e"))

    alone = tdoc.join(held.groupBy(*KEY).agg(F.min("n_e").alias("n_e")), KEY).select(*KEY, "t", share(F.lit(1)).alias("share"))
    telling = _meetings(held, tdoc, folder).withColumn("share", share(F.col("n_te"))).where(F.col("share") >= generalise)
    telling = stage(telling.select("entity", "t", "share"), "telling", folder)
    together = telling.join(tdoc.select(*KEY, "t"), "t").join(held.select(*KEY, "entity"), [*KEY, "entity"]).select(*KEY, "t", "share")
    worst = alone.where(F.col("share") >= generalise).unionByName(together).groupBy(*KEY, "t").agg(F.max("share").alias("share"))
    order = F.when(F.col("share") >= remove, ORDER.index("term_removed")).otherwise(ORDER.index("term"))
    span = F.struct("start", order.cast("int").alias("ord"), "end", F.col("term").alias("value"))
    return stage(words.join(worst, [*KEY, "t"]).groupBy(*KEY).agg(F.array_sort(F.collect_list(span)).alias("p_terms")), "terms", folder)


def with_terms(base: DataFrame, terms: DataFrame) -> DataFrame:
    """base with p_spans (base and terms, sorted); rows without entities have no terms and take no part in the join."""
    every = F.array_sort(F.concat("p_base", F.coalesce("p_terms", F.array().cast(SPAN))))
    some = base.where(F.size("p_base") > 0).join(terms, KEY, "left").withColumn("p_spans", every).drop("p_terms")
    return base.where(F.size("p_base") == 0).withColumn("p_spans", F.col("p_base")).unionByName(some)


def find_all(docs: DataFrame, **options) -> DataFrame:
    """p_doc, p_hash, p_base and p_spans (base and terms, sorted) of every row."""
    folder = shared_folder(docs.sparkSession)
    base = find_base(docs, folder)
    return with_terms(base, disclosing_terms(docs, base, folder, **options)).select(*KEY, "p_base", "p_spans")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with the spans of ``text`` replaced by placeholders; all columns stay."""
    folder = shared_folder(docs.sparkSession)
    base = find_base(docs, folder, rows=True)
    joined = with_terms(base, disclosing_terms(docs, base, folder, **options))
    # of overlapping spans the first stands, stretched to the end of the last
    merged = F.aggregate(
        "p_spans",
        F.array().cast(SPAN),
        lambda out, s: F.when((F.size(out) > 0) & (s["start"] < F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.element_at(out, -1).withField("end", F.greatest(F.element_at(out, -1)["end"], s["end"]))))).otherwise(
            F.concat(out, F.array(s))
        ),
    )
    tags = F.array(*[F.lit("" if k == "term_removed" else f"[{k.upper()}]") for k in ORDER])
    before = lambda i: F.when(i > 0, F.get("p_merged", i - 1)["end"]).otherwise(0)
    parts = F.transform("p_merged", lambda s, i: F.concat(F.substring("p_text", (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.element_at(tags, s["ord"] + 1)))
    rest = F.substring("p_text", (F.element_at("p_merged", -1)["end"] + 1).cast("int"), F.length("p_text"))
    clean = F.when(F.size("p_spans") == 0, F.col("p_row.text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    return joined.withColumn("p_merged", merged).select(*[clean.alias(c) if c == "text" else F.col("p_row").getField(c).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_all(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("p_base", lambda s: s["ord"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("p_doc").alias("doc_id"), *counts, F.sha2(written(F.col("p_base")), 256).alias("base_sha256"), written(F.col("p_spans")).alias("spans"))
