"""Order MinHash fingerprints: signatures that follow edit distance, not only shared content.

A text's k-mers of words are numbered by occurrence, so that a repeated k-mer counts as often
as it occurs. For each of ``M`` random orders the ``L`` least numbered k-mers are taken, put
back into text order, and hashed as a tuple. The orders are rotations of one 64-bit hash
order (order b starts at b/M of the hash range and wraps round), so one sort serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalforge.llm.common import let, shuffle_partitions, words_of

#: Words in a k-mer, k-mers in a tuple, tuples in a signature.
K, L, M = 2, 2, 32
#: Where each of the M orders starts.
BOUNDS = [-(2**63) + b * (2**64 // M) for b in range(M)]


def _numbered(h: Column) -> Column:
    """Hash of (k-mer, how often it came before) for each k-mer, in text order."""
    once = F.transform(h, lambda x: F.xxhash64(x, F.lit(0)))

    def by_run(s: Column) -> Column:
        """s: (k-mer, place) sorted, so that equal k-mers stand together in text order."""
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1).h != x.h), i)), lambda i: i.isNotNull()
        )
        runs = let(
            starts,
            lambda at: F.transform(
                at,
                lambda a, r: F.transform(
                    F.slice(s, a + 1, F.coalesce(F.get(at, r + 1), F.size(s)) - a),
                    lambda x, j: F.struct(x.p.alias("p"), F.xxhash64(x.h, j).alias("q")),
                ),
            ),
        )
        return F.transform(F.sort_array(F.flatten(runs)), lambda x: x.q)

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), once).otherwise(let(pairs, by_run))


def _tuples(h: Column, q: Column, s: Column) -> Column:
    """h: k-mers; q: numbered k-mers, both in text order; s: q sorted."""
    n = F.size(s)

    def first_at_least(bound: Column) -> Column:
        ends = F.aggregate(
            F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))).cast("int")),
            F.struct(F.lit(0).alias("lo"), n.alias("hi")),
            lambda e, _: let(
                F.floor((e.lo + e.hi) / 2).cast("int"),
                lambda mid: F.when(e.lo >= e.hi, e)
                .when(F.get(s, mid) < bound, F.struct((mid + 1).alias("lo"), e.hi.alias("hi")))
                .otherwise(F.struct(e.lo.alias("lo"), mid.alias("hi"))),
            ),
        )
        return ends.lo

    def one(bound: Column) -> Column:
        at = first_at_least(bound)
        places = let(
            at,
            lambda a: F.transform(
                F.sequence(F.lit(0), F.least(F.lit(L), n) - 1),
                lambda j: F.array_position(q, F.get(s, (a + j) % n)),
            ),
        )
        ordered = F.transform(F.sort_array(places), lambda p: F.get(h, (p - 1).cast("int")))
        return F.xxhash64(ordered).bitwiseAND(F.lit(0xFFFFFFFF))

    empty = F.array_repeat(F.lit(0).cast("long"), M)
    return F.when(n == 0, empty).otherwise(F.transform(F.array(*[F.lit(b) for b in BOUNDS]), one))


def signature(text: Column) -> Column:
    """Array of ``M`` longs. Null counts as empty; a text without words has an all-zero signature.

    Texts with fewer than ``K`` words have one k-mer, the whole sequence.
    """

    def kmers(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < K, F.array(F.xxhash64(w)))
            .otherwise(
                F.transform(
                    F.slice(w, F.lit(1), n - (K - 1)),
                    lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, K)]),
                )
            )
        )

    return let(
        words_of(text),
        lambda w: let(kmers(w), lambda h: let(_numbered(h), lambda q: let(F.sort_array(q), lambda s: _tuples(h, q, s)))),
    )


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    return same / F.lit(float(M))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the next row by descending doc_id; the first follows the last.

    Rows are dealt into ranges of doc_id of about equal counts (null ids last). The first row
    of each range is also sent to the range before it, so no range needs another one's rows and
    nothing is ordered in one task. Equal ids are ordered by text.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()
    bounds = sorted(set(found.q or []), reverse=True)
    # range b holds ids in [bounds[b], bounds[b-1]); the last range holds what is below all bounds, and nulls
    at = F.coalesce(
        F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda x: F.col("doc_id") >= x), True) - 1,
        F.lit(-1),
    ) if bounds else F.lit(-1)
    rows = docs.withColumn("_range", F.when(at >= 0, at).otherwise(F.lit(len(bounds))).cast("int"))
    heads = rows.groupBy("_range").agg(F.max("doc_id").alias("head")).orderBy("_range").collect()
    ranges = [(r["_range"], r["head"]) for r in heads]  # at most n rows
    head = F.lit(False)
    before = F.lit(None).cast("int")
    if ranges:
        into = {r: ranges[i - 1][0] for i, (r, _) in enumerate(ranges)}
        ids = {r: h for r, h in ranges}
        spots = F.create_map(*[F.lit(x) for pair in into.items() for x in pair])
        tops = F.create_map(*[y for r, h in ids.items() for y in (F.lit(r), F.lit(h).cast("long"))])
        head = F.col("doc_id").eqNullSafe(F.element_at(tops, F.col("_range")))
        before = F.element_at(spots, F.col("_range"))
    copies = F.when(
        head,
        F.array(
            F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")),
            F.struct(before.alias("r"), F.lit(True).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost"))))
    dealt = rows.withColumn("_to", F.explode(copies)).select("*", "_to.r", "_to.ghost").drop("_to", "_range")
    order = Window.partitionBy("r").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return ahead.filter(~F.col("ghost")).drop("r", "ghost")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint each whole text and its edited text, whose last third comes from the next document.

    Input: doc_id, text (other columns are ignored; null text counts as empty). One row for
    each input row, repeated rows included; an empty table gives an empty result.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("sig", signature(F.col("text")))
    rows = with_next(own, ["text", "sig"])
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)
    )
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_sig", signature(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sig")).alias("fingerprint"),
        as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
