"""Counterfactual-regularised toxicity classifier.

A logistic regression over the presence of words. Beside the usual ridge penalty, every
labelled text that names a group is compared with its counterfactuals, the same text with the
term swapped for another group's, and squared changes of the logit are penalised. In a linear
model a swap of a for b changes the logit by w[b] - w[a], so the penalty is a quadratic form in
the weights and Newton's method solves the whole problem.

The terms come from the labelled texts, whatever their languages: words that many neutral texts
use, so that they aren't insults, and that stand in each other's contexts. Terms of one's own
may be given instead.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those with the least hash of doc_id;
scoring is a column expression over whole texts.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.llm.common import let, stored

#: Labelled rows used at most, words in the model beside the terms, least texts with a word, and its least chi-square.
TRAIN_ROWS, WORDS, LEAST_TEXTS, LEAST_CHI = 20_000, 512, 5, 10.0
#: Weights of the ridge penalty and of the counterfactual penalty.
RIDGE, SWAP = 0.5, 2.0
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3
#: Terms at most, their least share of the neutral texts, and the least likeness of the neighbours of two that are swapped.
TERMS, NEUTRAL_SHARE, ALIKE = 128, 0.01, 0.3

Pairs = list[tuple[str, str]]


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    #: Swaps that were penalised.
    pairs: int = 0


def said(text: Column) -> Column:
    """Lower-case runs of letters, in order; an empty one may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters."""
    return F.array_distinct(said(text))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, said) of at most ``TRAIN_ROWS`` labelled documents; rows without id or label are left out."""
    held = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    held = held.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    taken = held.orderBy(F.xxhash64("_id"), "_id", "y").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("_id"))
    return rows.select("y", said(F.col("text")).alias("said"))


def interchangeable(rows: DataFrame, counts: DataFrame, neutral: int) -> Pairs:
    """Pairs of terms: words of many neutral texts whose neighbours, among these words, are alike.

    rows: (y, said); counts: (word, a, b), texts with it by class. At most ``TERMS`` words.
    """
    often = counts.filter(F.col("b") >= max(LEAST_TEXTS, NEUTRAL_SHARE * neutral)).orderBy(F.desc("b"), "word").limit(TERMS)
    terms = sorted(r["word"] for r in often.select("word").collect())
    if len(terms) < 2:
        return []
    known = F.filter("said", lambda w: F.array_contains(F.lit(terms), w))
    step = F.zip_with(known, F.slice(known, F.lit(2), F.greatest(F.size(known), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    found = rows.select(F.explode(step).alias("p")).filter(F.col("p.y").isNotNull()).groupBy("p.x", "p.y").count().collect()
    at = {w: i for i, w in enumerate(terms)}
    follows = np.zeros((len(terms), len(terms)))
    for r in found:  # at most TERMS squared
        follows[at[r["x"]], at[r["y"]]] = r["count"]
    near = np.sqrt(np.concatenate((follows, follows.T), axis=1))
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12)
    alike = near @ near.T
    return [(terms[i], terms[j]) for i in range(len(terms)) for j in range(len(terms)) if i != j and alike[i, j] >= ALIKE]


def fit(docs: DataFrame, labels: DataFrame, groups: list[tuple[str, ...]] | None = None, swap: float = SWAP) -> Model:
    """Choose the words that tell the classes apart best, then fit. Without labelled rows, every score is 0.5.

    groups: sets of terms that are swapped for one another, instead of those found in the texts.
    """
    rows = stored(training_rows(docs, labels))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if n0 + n1 == 0:
        return Model((), (), 0.0)
    seen = rows.select("y", F.explode(F.array_distinct("said")).alias("word")).filter(F.length("word") > 0)
    counts = stored(seen.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")))
    if groups is None:
        pairs = interchangeable(rows, counts, n0)
    else:
        pairs = [(a, b) for g in groups for a in g for b in g if a != b]
    if not pairs:
        warnings.warn("no terms can be swapped for one another: the counterfactual penalty is empty", stacklevel=2)
    terms = sorted({w for p in pairs for w in p})
    named = F.array_contains(F.lit(terms), F.col("word")) if terms else F.lit(False)
    p, q = F.col("a") / max(n1, 1), F.col("b") / max(n0, 1)
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    gain = (p - q) * (p - q) / F.greatest(share * (1 - share), F.lit(1e-9))
    telling = (F.col("a") + F.col("b") >= LEAST_TEXTS) & (gain * (n1 * n0 / (n1 + n0)) >= LEAST_CHI)
    best = counts.filter(telling | named).orderBy(named.cast("int").desc(), gain.desc(), "word").limit(WORDS + len(terms))
    words = sorted(r["word"] for r in best.select("word").collect())
    if not words:
        return Model((), (), 0.0)
    found = rows.select("y", F.array_intersect("said", F.lit(words)).alias("w")).toPandas()
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(found), len(words) + 1), np.uint8)
    x[:, -1] = 1
    for i, present in enumerate(found["w"]):
        x[i, [at[w] for w in present]] = 1
    penalty = RIDGE * np.eye(len(words) + 1) + swap * swaps(x, [(at[a], at[b]) for a, b in pairs if a in at and b in at])
    w = _newton(x, found["y"].to_numpy(float), penalty)
    return Model(tuple(words), tuple(w[:-1].tolist()), float(w[-1]), len(pairs))


def swaps(x: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Quadratic form of the logit changes over all swaps of a term a present in a text for b absent from it.

    A term's swaps count as one together, however many others it may be swapped for.
    """
    form, both = np.zeros((x.shape[1], x.shape[1])), sum(part.T @ part for _, part in _parts(x))
    partners = np.bincount([a for a, _ in pairs], minlength=x.shape[1])
    for a, b in pairs:
        times = (both[a, a] - both[a, b]) / partners[a]
        form[a, a] += times
        form[b, b] += times
        form[a, b] -= times
        form[b, a] -= times
    return form


def _parts(x: np.ndarray):
    """Slices of a few thousand rows, with the rows as floats."""
    for k in range(0, len(x), 2000):
        yield slice(k, k + 2000), x[k : k + 2000].astype(float)


def _newton(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    penalty = penalty.copy()
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        slope, curve = penalty @ w, penalty.copy()
        for at, part in _parts(x):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (p - y[at])
            curve += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a whole text; an empty or null text has the model's base rate."""
    if not model.words:
        return F.lit(0.5) + F.length(F.coalesce(text, F.lit(""))) * 0.0
    weights = F.map_from_arrays(F.lit(list(model.words)), F.lit(list(model.weights)))
    hits = F.array_intersect(tokens(text), F.lit(list(model.words)))
    logit = let(weights, lambda m: F.aggregate(hits, F.lit(model.bias), lambda t, w: t + F.element_at(m, w)))
    return 1 / (1 + F.exp(-logit))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, groups: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Add score and predicted to every row; labels of held-out rows are not learned.

    Input: doc_id, text and any other columns, which stay, but for a score or predicted of the
    caller's, which are replaced. Null text counts as empty. Repeated rows are scored alike; an
    id that has several labels is learned once for each. Empty tables give empty results.
    groups: see :func:`fit`.
    """
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), groups)
    rows = docs.withColumn("score", score(F.col("text"), model))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
