"""Runs of repeated words: stretches whose words recur at a fixed distance, found on a harmonic grid.

A run of period p holds at least 2 p words, so one of the grid points 0, p, 2p, ... begins a
pair of equal words p apart inside it. All pairs of a period and a grid point, about n log n for
n words, are made by NumPy; pairs of equal words are extended both ways at once by binary search
over prefix hashes. Hashes only ever extend too far, never too little, so each run found is
compared word by word, and a period whose run fails is scanned anew. A run is found at every
multiple of its period too, with the same ends; the least period stays.

Words are the maximal runs of characters other than ASCII white space. Null text has none. Rows
are handled by themselves, so ids may be null or repeated; an id that is null is never rewritten.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run, words of a text up to which the grid is kept, and pairs that are looked at together beyond.
LEAST, KEPT, TOGETHER = 12, 4096, 1 << 21

Run = tuple[int, int, int]


def grid(low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(j, p) for every period p of at most ``most`` and every multiple j of it with low <= j < high; low is 1 at least."""
    p = np.arange(1, min(most, high - 1) + 1)
    first = -(-low // p) * p
    count = np.maximum((high - 1 - first) // p + 1, 0)
    p_all = np.repeat(p, count)
    nth = np.arange(len(p_all)) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + nth * p_all, p_all


class Grid:
    """The pairs for texts of up to ``KEPT`` words, in order of j, so that those of a shorter text come first."""

    def __init__(self) -> None:
        j, p = grid(1, KEPT, KEPT // 2)
        order = np.argsort(j, kind="stable")
        self.j, self.p = j[order].astype(np.int32), p[order].astype(np.int32)
        self.i = self.j - self.p
        self.upto = np.searchsorted(self.j, np.arange(KEPT + 1))
        self.powers = np.ones(1, np.uint64)

    def power(self, n: int) -> np.ndarray:
        """Powers of the hash's base, modulo 2 ** 64."""
        if len(self.powers) < n:
            base = np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)
            base[0] = 1
            self.powers = np.cumprod(base, dtype=np.uint64)
        return self.powers

    def pairs(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, p) with j = i + p, in parts of bounded size."""
        if n <= KEPT:
            end = self.upto[n]
            yield self.i[:end], self.j[:end], self.p[:end]
            return
        step = max(1, int(TOGETHER / np.log(n)))
        for low in range(1, n, step):
            j, p = grid(low, min(low + step, n), n // 2)
            yield j - p, j, p


def runs_of(words: list[bytes], held: Grid) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, n)
    power, sums, found = held.power(n), None, []
    for i, j, p in held.pairs(n):
        at = np.flatnonzero(h[i] == h[j])
        if not len(at):
            continue
        i, j, p = (x[at].astype(np.int64) for x in (i, j, p))
        near = (i > 0) & (h[i - 1] == h[j - 1]) | (j + 1 < n) & (h[i + 1] == h[np.minimum(j + 1, n - 1)])
        at = np.flatnonzero(near & (2 * p <= n))
        if not len(at):
            continue
        i, j, p = i[at], j[at], p[at]
        if sums is None:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * power[:n], dtype=np.uint64)))
        shift = power[p]
        ahead = _longest(n - j, lambda x: (sums[i + x] - sums[i]) * shift == sums[j + x] - sums[j])
        back = _longest(i, lambda x: (sums[i] - sums[i - x]) * shift == sums[j] - sums[j - x])
        start, end = i - back, j + ahead
        at = end - start >= np.maximum(LEAST, 2 * p)
        if at.any():
            found.append((start[at] * (n + 1) + end[at], p[at]))
    if not found:
        return []
    out: dict[tuple[int, int], int] = {}
    ends, periods = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((periods, ends))
    ends, periods = ends[order], periods[order]
    new = (np.diff(ends, prepend=-1) != 0) | (np.diff(periods, prepend=-1) != 0)
    scanned: set[int] = set()
    for at, p in zip(ends[new].tolist(), periods[new].tolist(), strict=True):
        start, end = divmod(at, n + 1)
        if out.get((start, end), p + 1) <= p:
            continue
        if words[start : end - p] == words[start + p : end]:
            out[start, end] = p
        elif p not in scanned:
            scanned.add(p)
            for s, e in _scan(words, p):
                out[s, e] = min(p, out.get((s, e), p))
    return sorted((s, e - s, p) for (s, e), p in out.items())


def _longest(most: np.ndarray, agrees: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The greatest length up to ``most`` at which each pair's stretches agree, for all pairs at once."""
    low, high = np.zeros_like(most), most.copy()
    for _ in range(int(most.max()).bit_length()):
        middle = (low + high + 1) >> 1
        yes = agrees(middle)
        low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
        high = np.maximum(high, low)
    return low


def _scan(words: list[bytes], p: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs with period p, found by comparing all words."""
    equal = np.array([a == b for a, b in zip(words, words[p:], strict=False)] + [False], bool)
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0))
    for start, end in edges.reshape(-1, 2).tolist():
        if end + p - start >= max(LEAST, 2 * p):
            yield start, end + p


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds behind its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    kept = (np.cumsum(edge[:-1]) == 0).tolist()
    return b" ".join(w for w, k in zip(words, kept, strict=True) if k)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents get a run: from a place on, the next words are repeated to the end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_HELD: list[Grid] = []
ROWS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
SHAPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: its number of words, its runs, and its text with runs cut to their first period.

    ``rewrite`` may change a document's words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _HELD:
            _HELD.append(Grid())
        for batch in batches:
            counts, runs, texts = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                words = text.as_buffer().to_pybytes().split()  # bytes.split() cuts at ASCII white space alone
                if rewrite:
                    words = rewrite(i, words)
                found = runs_of(words, _HELD[0])
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found) if found else b" ".join(words))
            cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, SHAPE), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, ROWS)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one and digests of all runs and of the collapsed text."""
    best = F.element_at(
        F.array_sort(
            "runs",
            lambda a, b: F.when(a["length"] > b["length"], -1).when(a["length"] < b["length"], 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.when(a["period"] < b["period"], -1).otherwise(1)),
        ),
        1,
    )
    best = F.when(F.size("runs") > 0, best)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
