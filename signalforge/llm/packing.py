"""Best-fit packing of token sequences by a configuration linear program.

Pieces have at most ``CAPACITY`` lengths, so the histogram of lengths is all that packing
needs. The program's variables are configurations, multisets of lengths that fit one sequence;
it asks for the fewest sequences that hold every piece. Multiplicative weights solve it: each
round prices lengths by their size and by how much of them is covered, a knapsack dynamic
program finds the most valuable configuration and the best one with each length, and the shares
of those near the best are raised. Any prices bound the number of sequences from below, so the
gap is known. Shares are rounded to whole sequences while pieces last, what is left is solved
and rounded again, and the last few pieces are packed best fit.

The plan says which ranks of each length go to which sequence, and pieces find their place by
rank, wherever they are stored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalforge.llm.bpe import Encoder, encoder
from signalforge.llm.common import numbered, shuffle_partitions, stored

CAPACITY, END_ID = 1024, 2
#: Gap at which the program counts as solved, and pieces left to best fit.
GAP, REST = 0.01, 100
#: Ways to round, of which the better counts: rounds of a solution at most, and the part of its shares that is taken
#: before the rest is solved anew. Long steps suit even histograms, short ones those of a few long and many short pieces.
WAYS = ((200, 1.0), (30, 0.15))
#: How fast prices fall with coverage, what counts as near the best, and what breaks ties among prices.
RATE, NEAR, NOISE = 4.0, 0.1, 0.0005

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int) -> list[int]:
    """Lengths of the pieces of n ids: all ``CAPACITY`` but the first."""
    full, rest = divmod(n, CAPACITY)
    return [rest] * (rest > 0) + [CAPACITY] * full


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizer's JSON file gives ids of their own, wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError(f"{path} has added tokens that depend on the text around them")
    return {t["content"]: t["id"] for t in found}


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece. Null text is empty and has one piece, the closing id.

    The text between the strings of ``added`` is encoded by ranks, part by part.
    """
    whole = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
    cuts = "|".join(map(re.escape, sorted(whole, key=len, reverse=True)))

    def encoded(enc: Encoder, text: str) -> bytes:
        if not any(t in text for t in whole):
            return enc.encode(text)
        return b"".join(whole[t] if t in whole else enc.encode(t) for t in re.split(f"({cuts})", text) if t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        close = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoded(enc, text.as_py()) + close
                at = 0
                for k, n in enumerate(cut(len(ids) // 4)):
                    for x, v in zip(out, (doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])), strict=True):
                        x.append(v)
                    at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


Configuration = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best value, a length in it or 0) for each capacity; lengths ascend and may repeat in a configuration."""
    best, took = np.zeros(CAPACITY + 1), np.zeros(CAPACITY + 1, int)
    fitting = np.searchsorted(lengths, np.arange(CAPACITY + 1), side="right")
    for c in range(1, CAPACITY + 1):
        gains = best[c - lengths[: fitting[c]]] + values[: fitting[c]]
        i = int(np.argmax(gains)) if len(gains) else -1
        if i >= 0 and gains[i] > best[c - 1]:
            best[c], took[c] = gains[i], lengths[i]
        else:
            best[c] = best[c - 1]
    return best, took


def configuration(first: int, took: np.ndarray) -> Configuration:
    """(length, how many) of the best configuration that holds ``first``, longest first."""
    counts, c = {first: 1}, CAPACITY - first
    while c > 0:
        s = int(took[c])
        if s:
            counts[s] = counts.get(s, 0) + 1
        c -= s or 1
    return tuple(sorted(counts.items(), reverse=True))


def fractional(histogram: np.ndarray, rounds: int = WAYS[0][0]) -> tuple[dict[Configuration, float], float]:
    """Shares of configurations that cover every length, and a lower bound on the sequences needed."""
    lengths = np.flatnonzero(histogram)
    need = histogram[lengths].astype(float)
    where = np.zeros(CAPACITY + 1, int)
    where[lengths] = np.arange(len(lengths))
    ratio = np.zeros(len(lengths))
    shares: dict[Configuration, float] = defaultdict(float)
    bound, noise = 0.0, np.random.default_rng(0)
    for k in range(rounds):
        values = lengths / CAPACITY * np.exp(-RATE * (ratio - ratio.min()))
        if k:
            values *= 1 + NOISE * noise.random(len(lengths))
        best, took = knapsack(lengths, values)
        bound = max(bound, float(need @ values / best[CAPACITY]))
        if ratio.min() > 0 and sum(shares.values()) / ratio.min() <= (1 + GAP) * bound:
            break
        with_each = values + best[CAPACITY - lengths]
        gained = np.zeros(len(lengths))
        for i in np.argsort(-with_each, kind="stable"):
            if with_each[i] < (1 - NEAR) * best[CAPACITY]:
                break
            if gained[i] >= NEAR:
                continue
            chosen = configuration(int(lengths[i]), took)
            at, many = where[[s for s, _ in chosen]], np.array([n for _, n in chosen])
            if (gained[at] >= 2 * NEAR).any():
                continue
            step = NEAR * float((need[at] / many).min())
            shares[chosen] += step
            gained[at] += step * many / need[at]
            ratio[at] += step * many / need[at]
    least = max(float(ratio.min()), 1e-9)
    return {c: x / least for c, x in shares.items()}, bound


@dataclass(frozen=True)
class Group:
    """``count`` sequences that each hold the same pieces: (length, how many), in order."""

    pieces: tuple[tuple[int, int], ...]
    count: int


def best_fit(histogram: np.ndarray) -> list[Group]:
    """Best fit decreasing over the histogram; sequences with equal contents are one group."""
    open_: dict[int, list[Group]] = defaultdict(list)
    for s in range(CAPACITY, 0, -1):
        left = int(histogram[s])
        for room in range(s, CAPACITY):
            while left and open_[room]:
                g = open_[room].pop()
                each = room // s
                n = min(g.count, left // each) if left >= each else 1
                take = each if left >= each else left
                if g.count > n:
                    open_[room].append(Group(g.pieces, g.count - n))
                open_[room - take * s].append(Group((*g.pieces, (s, take)), n))
                left -= n * take
        each = CAPACITY // s
        if left >= each:
            open_[CAPACITY - each * s].append(Group(((s, each),), left // each))
        if left % each:
            open_[CAPACITY - left % each * s].append(Group(((s, left % each),), 1))
    return [g for groups in open_.values() for g in groups]


def rounded(histogram: np.ndarray, rounds: int, part: float) -> list[Group]:
    """The program's shares as whole sequences, solved again over what they leave; best fit for the last few pieces."""
    left = histogram.astype(int).copy()
    groups: list[Group] = []
    while int(left.sum()) > REST:
        before = int(left.sum())
        shares, bound = fractional(left, rounds)
        taken = part * min(1.0, bound / sum(shares.values())) if part < 1 else 1.0
        for chosen, share in sorted(shares.items(), key=lambda x: -x[1]):
            n = min(math.ceil(share * taken), *(int(left[s]) // many for s, many in chosen))
            if n > 0:
                groups.append(Group(chosen, n))
                for s, many in chosen:
                    left[s] -= n * many
        if int(left.sum()) > (1 - 0.1 * part) * before:  # no configuration of several lengths is left that fits what there is
            break
    return groups + best_fit(left)


def packed(histogram: np.ndarray) -> list[Group]:
    """The program rounded in the better one of ``WAYS``."""
    return min((rounded(histogram, *way) for way in WAYS), key=lambda found: sum(g.count for g in found))


def slots(groups: list[Group]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, pieces in each sequence, first sequence, offset there), by first rank."""
    used: dict[int, int] = defaultdict(int)
    found: dict[int, list] = defaultdict(list)
    sequence = 0
    for g in groups:
        offset = 0
        for s, many in g.pieces:
            found[s].append((used[s], many, sequence, offset))
            used[s] += many * g.count
            offset += many * s
        sequence += g.count
    return {s: np.array(x, np.int64) for s, x in found.items()}


def pack(pieces: DataFrame) -> DataFrame:
    """Add sequence_id and offset to every row of doc_id, piece, length (at most ``CAPACITY``).

    Other columns stay; columns named like the two, or with a leading underscore, go. Repeated
    rows are pieces of their own. An empty table gives an empty result.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset") and not c.startswith("_")]
    pieces = stored(pieces.select(*kept, F.monotonically_increasing_id().alias("_at")))
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most CAPACITY rows
    histogram = np.zeros(CAPACITY + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    plan = slots(packed(histogram))
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "_at"], "_rank", 4 * shuffle_partitions(pieces.sparkSession))
    names = kept

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                table = plan[int(s)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * s
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    kind = pieces.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*kept, "_rank").mapInArrow(place, kind)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, cut and pack every document; see :func:`tokenised` and :func:`pack`."""
    return pack(tokenised(docs, ranks_path, pattern, added))
