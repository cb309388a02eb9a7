"""Quality rules: a document whose character or word mix lies far from its language's is rejected.

Each document has two histograms: characters by class, and occurrences of its language's
``COMMON`` most frequent short words (all other words in one bin). Both are compared with the
same histograms over all documents of the language by Jensen-Shannon distance (base 2, the
square root of the divergence). Histograms of short texts are too noisy to judge, so each
comparison has a least length below which it never rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalforge.llm.common import let, stored, words_of

#: Common words of a language in its histogram.
COMMON = 24
#: Words of more code points are first counted in so many bins of each language, and one by one only where a bin could hold a common word.
LONG, BINS = 5, 4096
#: Largest distances of a kept document.
CHAR_DISTANCE, WORD_DISTANCE = 0.25, 0.4
#: Least word characters, and least words, for each comparison to count.
LEAST_CHARS, LEAST_WORDS = 150, 40
#: The base rule: least words, words in a repeated window, and most percent of repeated words.
BASE_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20

CLASSES = ("lower", "space", "upper", "digit", "symbol", "mark", "letter", "other")
SYMBOLS = "[#*$%&|<>]"
MARKS = r"[.,;:!?'\"()\-]"


def _outside(text: Column, pattern: str) -> Column:
    """Code points that ``pattern`` doesn't match."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeated(h: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text; h: the words' hashes."""
    n = F.size(h)
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice(h, F.lit(1), n - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, WINDOW)]),
        )
    )

    def covered(at: Column) -> Column:
        """at: places of repeated windows, ascending; each covers up to the next one's start."""
        parts = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p))
        return F.aggregate(parts, F.lit(0), lambda t, x: t + x)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1).h == x.h) | (F.get(s, i + 1).h == x.h))
        return F.sort_array(F.transform(twice, lambda x: x.p))

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(pairs, lambda s: let(places(s), covered))
        )

    return let(windows, count)


def features(docs: DataFrame) -> DataFrame:
    """Add _hashes (of the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _classes."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")
    rows = docs.withColumns({"_text": text, "_rest": rest, "_words": words_of(F.col("text")), "_lines": lines})
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeated(F.col("_hashes")).cast("long"),
            "_kinds": F.array(
                F.length("_text") - F.length("_rest"),
                *[
                    F.length("_rest") - _outside(F.col("_rest"), p)
                    for p in (r"\p{Lu}", r"\p{Nd}", SYMBOLS, MARKS, r"[\p{L}&&[^\p{Lu}]]")
                ],
                F.length("_rest"),
            ),
            "_blank": F.length("_text"),
        }
    )
    k = [F.col("_kinds")[i] for i in range(7)]
    space = F.col("_blank") - F.col("word_chars")
    counts = [k[0] - space, space, *k[1:6], k[6] - k[1] - k[2] - k[3] - k[4] - k[5]]
    rows = rows.withColumns(
        {"n_symbols": k[3].cast("long"), "_classes": F.array(*[c.cast("double") for c in counts])}
    )
    return rows.drop("_text", "_rest", "_lines", "_kinds", "_blank", "_words")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < BASE_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


def _shares(counts: Column) -> Column:
    return let(
        F.aggregate(counts, F.lit(0.0), lambda t, x: t + x),
        lambda total: F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda t, x: t + x) / 2))


def _word_counts(hashes: Column, common: Column) -> Column:
    """Occurrences of each of ``common``, then of all other words, by the words' hashes."""
    return let(
        F.transform(common, lambda c: F.xxhash64(c)),
        lambda known: let(
            F.filter(hashes, lambda h: F.array_contains(known, h)),
            lambda at: F.concat(
                F.transform(known, lambda k: (F.size(at) - F.size(F.array_remove(at, k))).cast("double")),
                F.array((F.size(hashes) - F.size(at)).cast("double")),
            ),
        ),
    )


def _common(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, words, counts, n): the ``COMMON`` most frequent words of each language, or of all (lang null), and words in all.

    Ties go by the word; words start with a letter. Frequent words are short, so long ones are
    counted in bins: a bin below the last of the most frequent short words has no common word.
    The words of other bins are counted one by one, so nothing depends on a word's length.
    """
    said = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    letter = F.col("word").rlike(r"^\p{L}")
    short = F.when(letter & (F.length("word") <= LONG), F.col("word"))
    bin_ = F.when(letter & (F.length("word") > LONG), F.pmod(F.xxhash64("word"), F.lit(BINS)).cast("int"))
    counts = stored(said.groupBy("lang", short.alias("word"), bin_.alias("bin")).agg(F.count("*").alias("n")))
    whole = counts.groupBy("word", "bin").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    named = counts.filter(F.col("lang").isNotNull())
    both = {"lang": named, "all": whole.select(*named.columns)}

    def top(rows: DataFrame) -> DataFrame:
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        return rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= COMMON)

    # bins that reach the last of the most frequent short words, in a language or in all
    open_ = []
    for rows in both.values():
        last = top(rows.filter(F.col("word").isNotNull())).groupBy("lang").agg(F.min("n").alias("least"), F.count("*").alias("found"))
        bins = rows.filter(F.col("bin").isNotNull()).withColumnRenamed("lang", "of").join(last.withColumnRenamed("lang", "has"), F.col("of").eqNullSafe(F.col("has")), "left")
        open_.append(bins.filter((F.coalesce("found", F.lit(0)) < COMMON) | (F.col("n") >= F.col("least"))).select("of", "bin"))
    asked = stored(open_[0].unionByName(open_[1]).distinct())
    long = said.limit(0).groupBy("lang", "word").agg(F.count("*").alias("n"))
    if not asked.isEmpty():
        in_bins = said.withColumn("bin", bin_).filter(F.col("bin").isNotNull())
        every = asked.filter(F.col("of").isNull()).select("bin")  # open in all: of each language's words
        one = asked.filter(F.col("of").isNotNull()).join(every, "bin", "left_anti").withColumnRenamed("of", "lang")
        picked = in_bins.join(every, "bin", "left_semi").select("lang", "word").unionByName(in_bins.join(one, ["lang", "bin"], "left_semi").select("lang", "word"))
        long = stored(picked.groupBy("lang", "word").agg(F.count("*").alias("n")))
    found = []
    for kind, rows in both.items():
        own = long.filter(F.col("lang").isNotNull()) if kind == "lang" else long.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
        best = top(rows.filter(F.col("word").isNotNull()).select("lang", "word", "n").unionByName(own.select("lang", "word", "n")))
        held = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "n"))).alias("b"))
        sums = rows.groupBy("lang").agg(F.sum("n").alias("n")).withColumnRenamed("lang", "of")
        held = sums.join(held, F.col("of").eqNullSafe(F.col("lang")), "left")
        none = F.array().cast(held.schema["b"].dataType)
        listed = F.coalesce("b", none)
        found.append(held.select(F.col("of").alias("lang"), listed["word"].alias("words"), listed["n"].alias("counts"), "n"))
    return found[0], found[1]


REFERENCE = "lang string, class_q array<double>, common array<string>, word_q array<double>"


def references(docs: DataFrame) -> DataFrame:
    """One row for each language, and one for all documents (lang null): class shares, common words, word shares.

    Counts run over all documents; the shares of the words end with that of all other words.
    """
    rows = docs.select("lang", "text")
    text = F.coalesce("text", F.lit(""))
    rest = F.regexp_replace(text, r"[a-z]+", "")
    inner = F.regexp_replace(rest, r"[\x20\x09-\x0D]+", "")
    kinds = rows.select(
        "lang",
        F.length(text).alias("n"),
        F.length(rest).alias("r"),
        inner.alias("inner"),
    )
    patterns = (r"\p{Lu}", r"\p{Nd}", SYMBOLS, MARKS, r"[\p{L}&&[^\p{Lu}]]")
    kinds = kinds.select(
        "lang",
        (F.col("n") - F.col("r")).alias("c0"),
        (F.col("r") - F.length("inner")).alias("c1"),
        *[(F.length("inner") - _outside(F.col("inner"), p)).alias(f"c{i + 2}") for i, p in enumerate(patterns)],
        F.length("inner").alias("c7"),
    )
    sums = stored(kinds.groupBy("lang").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(8)]))
    whole = sums.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(8)]).withColumn("lang", F.lit(None).cast("string"))
    classes = sums.filter(F.col("lang").isNotNull()).unionByName(whole.select(*sums.columns))
    own, all_ = _common(docs)
    words = own.unionByName(all_).withColumnRenamed("lang", "of")
    joined = classes.join(words, F.col("lang").eqNullSafe(F.col("of")), "left")
    counts, n = F.coalesce("counts", F.array().cast("array<bigint>")), F.coalesce("n", F.lit(0))
    listed = F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + x)
    c = [F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("double") for i in range(8)]
    rest_of = c[7] - c[2] - c[3] - c[4] - c[5] - c[6]
    return joined.select(
        "lang",
        _shares(F.array(*c[:7], rest_of)).alias("class_q"),
        F.coalesce("words", F.array().cast("array<string>")).alias("common"),
        F.when(n > 0, _shares(F.transform(F.concat(counts, F.array((n - listed).cast("long"))), lambda x: x.cast("double")))).otherwise(F.array(F.lit(1.0))).alias("word_q"),
    )


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")


def judge(docs: DataFrame) -> DataFrame:
    """Features, both distances, base_failed and kept for every row.

    Input: doc_id, text, lang and any other columns, which stay, whatever their names; only those
    named like a feature are replaced. Null text counts as empty and fails the base rule. A null
    language is compared with the pooled references. Repeated rows are judged alike. An empty
    table gives an empty result.
    """
    found = stored(references(docs))
    pooled = found.filter(F.col("lang").isNull()).first()
    refs = found.filter(F.col("lang").isNotNull()).select(F.col("lang").alias("_lang"), F.col("class_q").alias("_class_q"), F.col("common").alias("_common"), F.col("word_q").alias("_word_q"))
    class_q, common, word_q = pooled[1:] if pooled else ([0.0] * 8, [], [1.0])
    pool = lambda x, kind: F.array(*[F.lit(v) for v in x]).cast(kind)
    rows = features(docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang"))
    rows = rows.join(refs, F.col("lang") == F.col("_lang"), "left")  # Spark broadcasts a few languages; many are shuffled
    rows = rows.withColumns(
        {
            "_class_q": F.coalesce("_class_q", pool(class_q, "array<double>")),
            "_common": F.coalesce("_common", pool(common, "array<string>")),
            "_word_q": F.coalesce("_word_q", pool(word_q, "array<double>")),
        }
    )
    rows = rows.withColumns(
        {
            "char_distance": distance(_shares(F.col("_classes")), F.col("_class_q")),
            "word_distance": distance(_shares(_word_counts(F.col("_hashes"), F.col("_common"))), F.col("_word_q")),
        }
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    far = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_DISTANCE)) | (
        (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > WORD_DISTANCE)
    )
    # a filter isn't moved below a column that isn't deterministic; below the features it would work them out many times
    kept = F.when(F.monotonically_increasing_id() >= 0, ~failed & ~far)
    rows = rows.withColumns({"base_failed": failed, "kept": kept})
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in FEATURES], *FEATURES)
