"""Ranked lexical search over an impact-ordered index, score at a time.

A term's impact in a document is what its occurrences and the document's length give; times the
term's weight it is what the term adds to a score. Documents are counted once and stored as rows
of (terms of the items, occurrences). The index is by documents: a task turns each batch of
documents into postings grouped by term and exact impact, and takes, for each item, the groups of
its terms by descending contribution. It stops when no document beyond a few candidates can reach
the item's least held score, by the greatest contributions that its terms have left, and then
completes the candidates' scores. What a task has found so far bounds its next batches. Tasks
return their best documents for each item, which two windows merge.

Items are dealt into blocks whose terms are bounded (``TERMS``); each block meets all documents.
Rows of one item_id are one item, with the terms of all its texts. Null text has no terms; an
item without a term in any document has no rows. Repeated documents are ranked each by itself,
and documents without an id come last among equal scores. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalforge.llm.common import shuffle_partitions, stored

#: Documents of an item, terms of a block of items, and parts in which an item's groups are taken.
BEST, TERMS, PARTS = 10, 500_000, 8
#: Weights of occurrences and of length in an impact.
SCALE, PER_TERM, PER_LENGTH, SHARE = 1_000_000_000, 1000, 8, 90
#: Every byte of a term stays, but A-Z becomes a-z; bytes above 0x7F belong to terms.
LOWER = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Stands for a missing id, the greatest long.
LAST = 2**63 - 1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and which of the vocabulary it holds how often."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most ``TERMS`` and one item's more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                words = terms_of(text.as_buffer().to_pybytes())
                codes = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                found, count = np.unique(codes[codes >= 0], return_counts=True)
                n.append(len(words))
                terms.append(found.tobytes())
                tfs.append(count.astype(np.int32).tobytes())
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_counts(rows: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    found = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(terms, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)


@dataclass
class Index:
    """Postings of some documents, by term and descending impact; groups have one term and one impact.

    ``first`` and ``groups`` say where a term's groups and a group's postings start.
    """

    docs: np.ndarray
    impacts: np.ndarray
    groups: np.ndarray
    first: np.ndarray
    own: np.ndarray  # a document's own terms and impacts start here
    own_terms: np.ndarray
    own_impacts: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes], tfs: list[bytes], n: np.ndarray, n_docs: int, n_terms: int, vocabulary: int) -> Index:
        held = np.array([len(x) // 4 for x in terms], np.int64)
        term, tf = np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(tfs), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(held)), held)
        length = 100 - SHARE + SHARE * n * n_docs // max(1, n_terms)
        impact = SCALE * tf // (PER_TERM * tf + PER_LENGTH * length[doc])
        order = np.lexsort((-impact, term))
        by_term, by_impact = term[order], impact[order]
        new = (np.diff(by_term, prepend=-1) != 0) | (np.diff(by_impact, prepend=-1) != 0)
        groups = np.flatnonzero(new)
        first = np.searchsorted(by_term[groups], np.arange(vocabulary + 1))
        own = np.concatenate(([0], np.cumsum(held)))
        return cls(doc[order], by_impact[groups], np.append(groups, len(order)), first, own, term, impact)


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the spans, end to end; which span each is of)."""
    size = ends - starts
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(starts - np.cumsum(size) + size, size), which


def candidates(index: Index, terms: np.ndarray, weight: np.ndarray, least: int, best: int) -> np.ndarray:
    """Documents that may be among the ``best``, all others being proven not to be.

    ``least`` is a score that ``best`` other documents are known to reach, or 0.
    """
    place, which = spans(index.first[terms], index.first[terms + 1])
    if not len(place):
        return place
    adds = index.impacts[place] * weight[which]
    order = np.argsort(-adds, kind="stable")
    place, which, adds = place[order], which[order], adds[order]
    starts, ends = index.groups[place], index.groups[place + 1]
    taken = np.cumsum(ends - starts)
    groups_of = np.bincount(which, minlength=len(terms))
    sums = np.zeros(len(index.own) - 1, np.int64)
    done, at = np.zeros(len(terms), np.int64), 0
    # where in the order each term's n-th group stands: its groups keep their own order
    by_term = np.argsort(which, kind="stable")
    before = np.cumsum(groups_of) - groups_of
    for k in range(1, PARTS + 1):
        upto = int(np.searchsorted(taken, taken[-1] * k // PARTS, side="left")) + 1
        if upto <= at:
            continue
        postings, group = spans(starts[at:upto], ends[at:upto])
        np.add.at(sums, index.docs[postings], adds[at:upto][group])
        done += np.bincount(which[at:upto], minlength=len(terms))
        at = upto
        more = done < groups_of
        left = int(adds[by_term[before[more] + done[more]]].sum())
        if len(sums) > best:
            least = max(least, int(np.partition(sums, -best)[-best]))
        if not left:
            break
        if left < least and np.count_nonzero(sums + left >= least) <= 4 * best:
            break
    return np.flatnonzero((sums + left >= max(least, 1)) & (sums > 0))


def scores(index: Index, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
    """The whole scores of some documents, from their own terms."""
    place, which = spans(index.own[docs], index.own[docs + 1])
    out = np.zeros(len(docs), np.int64)
    np.add.at(out, which, weight_of[index.own_terms[place]] * index.own_impacts[place])
    return out


def searched(rows: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """(item, doc_id, score): for each item the best of every task, by its place in ``items``."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weight))  # one block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        held: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            ids = [LAST if i is None else i for i in batch.column("doc_id").to_pylist()]
            n = batch.column("n").to_numpy()
            index = Index.of(batch.column("terms").to_pylist(), batch.column("tfs").to_pylist(), n, n_docs, n_terms, len(weight))
            weight_of = np.zeros(len(weight), np.int64)
            for k, (_, terms) in enumerate(asked):
                least = -held[k][-1][0] if len(held[k]) == best else 0
                docs = candidates(index, terms, weight[terms], least, best)
                if not len(docs):
                    continue
                weight_of[terms] = weight[terms]
                found = scores(index, docs, weight_of)
                weight_of[terms] = 0
                new = [(-s, ids[d]) for s, d in zip(found.tolist(), docs.tolist(), strict=True) if s >= max(least, 1)]
                held[k] = sorted(held[k] + new)[:best]
        out = [(k, None if d == LAST else d, -s) for k, rows in enumerate(held) for s, d in rows]
        cols = zip(*out, strict=True) if out else ([], [], [])
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def _block(docs: DataFrame, items: DataFrame, best: int) -> DataFrame:
    """Rank documents for the items of one block, whose terms the driver holds."""
    texts: dict[int | None, set[bytes]] = {}
    for i, text in items.toLocalIterator():
        texts.setdefault(i, set()).update(terms_of((text or "").encode()))
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*texts.values())))}
    asked = [(i, np.array(sorted(vocabulary[t] for t in terms), np.int64)) for i, terms in texts.items() if terms]
    rows = stored(counted(docs, vocabulary))
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(document_counts(rows, len(vocabulary)), n_docs)
    found = searched(rows, asked, weight, n_docs, n_terms, best)
    # each task has at most ``best`` rows of an item; they meet in two steps
    slices = max(1, math.isqrt(shuffle_partitions(docs.sparkSession)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "_slice"], ["item"]):
        if "_slice" in keys:
            found = found.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(asked)], "item int, item_id long")
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents (doc_id, text) for each item (item_id, text)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 2 / TERMS))  # a term and what ends it take two characters at least
    if blocks == 1:
        return _block(docs, items, best)
    dealt = [items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_block(docs, d, best) for d in dealt])
