"""Exact n-gram Jaccard self-join with set-relation skipping.

Each document is the set of its distinct word shingles, as 64-bit hashes. Equal sets are one
node. Two nodes of similarity ``percent`` or more share tokens in their prefixes under any
common order of tokens (one, or k where prefixes are k - 1 tokens longer; of the larger set's
prefix and a shorter one of the smaller); the order here is by hash, with frequent tokens last.

Skipping within the index: the list of a token is ordered by set size and, within a size, by
the token's position. Sizes out of reach are skipped, and between blocks of two sizes the
entries whose position leaves too few tokens before or behind.

Skipping by relations between sets: a token of one set only can't be in an overlap, so a set
that shares too few of its tokens with any other has no answers, and a pair of sets overlaps in
no more tokens than either one shares. Every set left is compared with one similar set of its
lists, its lead, and linked sets form components, which chains through the lists then join
further. Pairs inside a component need no comparison. For the others, the answers of a set
follow from its lead's: what each has and lacks of the lead bounds the overlap of both from below
and above, and so do sketches of both. Only pairs that the bounds leave open are compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.llm.common import shuffle_partitions, stored, thrifty, thrifty_group
from signalforge.llm.components import components

#: Words of a shingle and least similarity of linked sets, where the caller names none.
SHINGLE, PERCENT = 4, 85
#: Tokens that are put last in the order at most, the most frequent ones; it only affects speed.
HOT = 1_000_000
#: A token's least count among a task's distinct sets to be counted as frequent.
HOT_LOCAL = 2
#: Tokens that a task counts at once.
HOT_TOKENS = 6_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the hashes (any odd numbers do).
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.array(
    [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of lower-cased bytes, by differences of one running polynomial."""
    solid = ~_IS_SPACE[raw]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.uint64)
    powers, inverse = _powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])))
    return _mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


_held: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest text so far."""
    if not _held or len(_held[0]) < n:
        size = max(n, 1 << 16)
        back = np.uint64(pow(int(_BASE), -1, 2**64))
        _held[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, back)]
    return _held[0], _held[1]


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; one for fewer words than a shingle has."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = _word_hashes(raw)
    if len(w) == 0:
        return w
    if len(w) < shingle:
        x = np.array([len(w)], np.uint64)
        for i in range(len(w)):
            x += w[i : i + 1] * _PLACES[i]
        return _mixed(x)
    n = len(w) - shingle + 1
    x = w[:n] * _PLACES[0]
    for i in range(1, shingle):
        x += w[i : i + n] * _PLACES[i]
    return np.unique(_mixed(x))


def _node(s: np.ndarray) -> int:
    """64-bit digest of a set."""
    total = np.sum(_mixed(s ^ _PLACES[0]), dtype=np.uint64, keepdims=True) + _PLACES[1:2] * np.array([len(s)], np.uint64)
    return int(_mixed(total).view(np.int64)[0])


def _kept(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def _need(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return -(-(a + b) * percent // (100 + percent))


def _again(t: np.ndarray, times: int) -> np.ndarray:
    """Of sorted values: whether each one is the first of ``times`` equal ones in a row."""
    return np.append(t[times - 1 :] == t[: len(t) - times + 1], np.zeros(min(times - 1, len(t)), bool))


def hot_tokens(docs: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent tokens, least frequent first; counts that stay small in a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(HOT_TOKENS, np.uint64)
        seen: set[int] = set()
        size = 0

        def counted() -> pa.RecordBatch:
            t = held[:size]
            t.sort()
            often = _again(t, HOT_LOCAL)
            first = np.flatnonzero(often & ~np.append(False, often[:-1]))
            n = np.flatnonzero(often & ~np.append(often[1:], False)) - first + HOT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(t[first].view(np.int64)), pa.array(n)], ["token", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingles(text, shingle)
                if (node := _node(s)) in seen:
                    continue
                if size + len(s) > len(held):
                    if size:
                        yield counted()
                    if len(s) > len(held):
                        held = np.empty(len(s), np.uint64)
                    size = 0
                    seen.clear()
                seen.add(node)
                held[size : size + len(s)] = s
                size += len(s)
        if size:
            yield counted()

    found = docs.select("text").mapInArrow(thrifty(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = stored(found)
    # the least count that at most HOT tokens reach, from the number of tokens of each count below a bound
    capped = found.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("tokens")).collect()
    least, total = 1 << 62, 0
    for n, tokens in sorted(((r["n"], r["tokens"]) for r in capped), reverse=True):
        total += tokens
        if total > HOT:
            break
        least = n
    top = found.filter(F.col("n") >= least).toArrow()  # at most HOT rows
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    return token[np.lexsort((token, n))]


def nodes_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, node) per row: size and digest of its set; equal sets have equal nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, shingle) for t in batch.column("text").to_pylist()]
            n, node = pa.array(map(len, found), pa.int32()), pa.array(map(_node, found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, node], ["doc_id", "n", "node"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(thrifty(run), "doc_id long, n int, node long")


def votes_needed(n):
    """Tokens that the prefixes of two linked sets share at least, for the smaller of the two sizes."""
    return 1 + n * 3 // 100


def prefix(s: np.ndarray, by_token: np.ndarray, ordered: np.ndarray, percent: int) -> np.ndarray:
    """First tokens of a set in the common order; long enough for ``votes_needed`` to be shared."""
    n = len(s)
    length = min(n, n - int(_kept(n, percent)) + int(votes_needed(n))) if n else 0
    if not len(ordered):
        return s[:length]
    at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
    is_hot = ordered[at] == s
    cold = s[~is_hot]
    if len(cold) < length:
        cold = np.concatenate((cold, s[is_hot][np.argsort(by_token[at[is_hot]])]))
    return cold[:length]


#: Tokens behind each shuffled block of postings.
BLOCK_TOKENS = 2_000_000


def _blocks(held: list[tuple[int, int, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """(node, size, tokens) of some sets as one row for each bucket of tokens.

    A token is sent as its bucket and 32 more bits; two tokens that agree in both share a list,
    which can add candidates and loses none. held is emptied.
    """
    size = np.array([len(h[2]) for h in held])
    names, sizes = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
    bucket, small = np.empty(int(size.sum()), "i4"), np.empty(int(size.sum()), "u4")
    pos = np.empty(len(small), "u4")
    for h, hi in zip(held, np.cumsum(size), strict=True):
        hashed, lo = _mixed(h[2].view(np.uint64)), hi - len(h[2])
        bucket[lo:hi] = hashed % np.uint64(buckets)
        small[lo:hi] = hashed >> np.uint64(32)
        pos[lo:hi] = np.arange(hi - lo)
    held.clear()
    of = np.repeat(np.arange(len(size), dtype="i4"), size)
    order = np.argsort(bucket, kind="stable").astype("i4")
    last = np.cumsum(np.bincount(bucket))
    found = np.flatnonzero(np.diff(last, prepend=0))
    rows = []
    for b, lo, hi in zip(found, np.append(0, last[found[:-1]]), last[found], strict=True):
        o = order[lo:hi]
        own, place = np.unique(of[o], return_inverse=True)
        raw = [small[o], place.astype("u4"), pos[o], names[own], sizes[own].astype("u4")]
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in raw))
        rows.append((int(b), len(o), data))
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "size", "data"])


def _entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(token, n, pos, node) of all blocks of one bucket."""
    parts = []
    for bucket, size, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "size", "data")), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(data)
        small, place, pos = np.frombuffer(raw[: 12 * size], "u4").reshape(3, size)
        rest = raw[12 * size :]
        own = len(rest) // 12
        names, sizes = np.frombuffer(rest[: 8 * own], np.int64), np.frombuffer(rest[8 * own :], "u4")
        token = small.astype(np.int64) + (bucket << 32)
        parts.append((token, sizes[place].astype(np.int32), pos.astype(np.int32), names[place]))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def postings(docs: DataFrame, hot: np.ndarray, buckets: int, shingle: int, percent: int) -> DataFrame:
    """Blocks of the sets' prefixes, dealt by token; each set once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token = np.argsort(hot)
        ordered = hot[by_token]
        held: list[tuple[int, int, np.ndarray]] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingles(text, shingle)
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                held.append((node, len(s), prefix(s.view(np.int64), by_token, ordered, percent).copy()))  # a slice would hold the whole set
                size += len(held[-1][2])
                if size >= BLOCK_TOKENS:
                    yield _blocks(held, buckets)
                    size = 0
                    if len(seen) > 1_000_000:  # a set sent twice is met again in its lists
                        seen.clear()
        if held:
            yield _blocks(held, buckets)

    return docs.select("text").mapInArrow(thrifty(run), "bucket int, size int, data binary")


def lists(blocks: DataFrame) -> DataFrame:
    """(token, n, pos, node) of every list of two sets or more."""

    def run(table: pa.Table) -> pa.Table:
        token, n, pos, node = _entries(table)
        order = np.lexsort((node, token))
        token, n, pos, node = token[order], n[order], pos[order], node[order]
        again = np.append(False, (token[1:] == token[:-1]) & (node[1:] == node[:-1]))
        token, n, pos, node = token[~again], n[~again], pos[~again], node[~again]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(begin, len(token)))
        many = np.repeat(count > 1, count)
        return pa.table({k: v[many] for k, v in {"token": token, "n": n, "pos": pos, "node": node}.items()})

    return blocks.groupBy("bucket").applyInArrow(thrifty_group(run), "token long, n int, pos int, node long")


def shared_tokens(whole: DataFrame, buckets: int) -> DataFrame:
    """(node, shared): tokens of each set that other sets have too; at least as many, see :func:`_blocks`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column("tokens")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for node, a, b in zip(batch.column("node").to_pylist(), offsets, offsets[1:], strict=False):
                held.append((node, b - a, flat[a:b]))
                size += b - a
                if size >= BLOCK_TOKENS:
                    yield _blocks(held, buckets)
                    size = 0
        if held:
            yield _blocks(held, buckets)

    def count(table: pa.Table) -> pa.Table:
        token, _, _, node = _entries(table)
        order = np.argsort(token)
        t = token[order]
        same = t[1:] == t[:-1]
        many = np.append(same, False) | np.append(False, same)
        names, times = np.unique(node[order[many]], return_counts=True)
        return pa.table({"node": names, "shared": times})

    blocks = whole.select("node", "tokens").mapInArrow(thrifty(cut), "bucket int, size int, data binary")
    counts = blocks.groupBy("bucket").applyInArrow(thrifty_group(count), "node long, shared long")
    return counts.groupBy("node").agg(F.sum("shared").alias("shared"))


#: Words of 64 bits in a sketch; each token of a set flips one bit, so two sets differ in as many tokens as bits at least.
WORDS = ("x0", "x1", "x2", "x3")


def sketches(whole: DataFrame) -> DataFrame:
    """(node, one column for each of ``WORDS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            h = _mixed(flat.view(np.uint64))
            at = np.repeat(np.arange(len(sizes)), sizes) * len(WORDS) + (h >> np.uint64(58)).astype(np.int64) % len(WORDS)
            bits = np.zeros(len(sizes) * len(WORDS), np.uint64)
            np.bitwise_xor.at(bits, at, np.uint64(1) << (h & np.uint64(63)))
            words = bits.view(np.int64).reshape(-1, len(WORDS)).T
            yield pa.RecordBatch.from_arrays([batch.column("node"), *map(pa.array, words)], ["node", *WORDS])

    return whole.select("node", "tokens").mapInArrow(thrifty(run), "node long, " + ", ".join(f"{w} long" for w in WORDS))


#: Rounds that link components along chains, one pair for each set, before all open pairs are taken.
CHAIN_ROUNDS = 1
#: Rows of ids that may be broadcast; more are joined by a shuffle.
FEW = 200_000
#: Bits of the filter that picks documents by id, and bits for each id; more ids than fit are picked by a join.
FILTER_BITS, BITS_EACH = 1 << 25, 8


def whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, tokens) for each of nodes (node, first_id), from the text of its first document; repeated rows repeat it.

    A bitmap of ids of fixed size drops the other texts before they are read as words; beyond
    its size the ids are joined with the documents instead.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bitmap = np.full(FILTER_BITS // 32, 0xFFFFFFFF, np.uint32)
    if (many := nodes.count()) * BITS_EACH <= FILTER_BITS:
        words = nodes.select(F.pmod(F.xxhash64("first_id"), F.lit(FILTER_BITS)).alias("bit"))
        words = words.selectExpr("bit div 32 AS word", "shiftleft(1L, cast(bit % 32 AS int)) AS mask")
        held = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most FILTER_BITS / 32 rows
        bitmap[:] = 0
        bitmap[held["word"].to_numpy(np.int64)] = held["mask"].to_numpy(np.int64)
    else:
        rows = rows.join(nodes, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            wanted = np.flatnonzero((bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
            texts = batch.column("text").take(pa.array(wanted)).to_pylist()
            found = [x for t in texts if len(x := shingles(t, shingle))]
            node = pa.array([_node(x) for x in found], pa.int64())
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in found]))).astype(np.int32)
            flat = pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "tokens"])

    found = rows.select("text", bit.alias("bit")).mapInArrow(thrifty(run), "node long, tokens array<long>")
    return found.join(_sent(nodes.select("node"), many), "node", "left_semi")


def _sent(ids: DataFrame, many: int) -> DataFrame:
    """ids, broadcast if they are few."""
    return F.broadcast(ids) if many <= FEW else ids


def _lists(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole lists: batches are sorted by token, and the last token of one may go on in the next."""
    held: list[dict] = []
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        token = cols["token"]
        if not len(token):
            continue
        last = int(np.searchsorted(token, token[-1]))
        if last == 0 and held and held[0]["token"][0] == token[0]:
            held.append(cols)
            continue
        if held and held[0]["token"][0] != token[0]:
            yield {c: np.concatenate([h[c] for h in held]) for c in names}
            held = []
        parts = [*held, {c: v[:last] for c, v in cols.items()}]
        if sum(len(p["token"]) for p in parts):
            yield {c: np.concatenate([p[c] for p in parts]) for c in names}
        held = [{c: v[last:] for c, v in cols.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}


def _leads(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a list with its lead there: the set with fewest tokens of its own, or the least, within reach of its size."""
    names = ["token", "n", "pos", "node", "s"]
    for c in _lists(batches, names):
        token, n, pos, node, s = (c[x].astype(np.int64) for x in names)
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        lead = np.arange(len(token))
        for b, e in zip(begin, np.append(begin[1:], len(token)), strict=True):
            if e - b < 2:
                continue
            centre = b + int(np.lexsort((node[b:e], n[b:e] - s[b:e]))[0])
            near = _kept(np.maximum(n[b:e], n[centre]), percent) <= np.minimum(n[b:e], n[centre])
            lead[b:e][near] = centre
            first = b
            for i in b + np.flatnonzero(~near):
                if _kept(int(n[i]), percent) > n[first]:
                    first = i
                lead[i] = first
        use = np.flatnonzero(lead != np.arange(len(token)))
        lead = lead[use]
        need = _need(n[use], n[lead], percent)
        spare = votes_needed(np.minimum(n[use], n[lead])) - need
        early = (pos[use] < n[use] + spare) & (pos[lead] < n[lead] + spare) & (np.minimum(s[use], s[lead]) >= need)
        use, lead = use[early], lead[early]
        cols = [node[use], node[lead], n[use], n[lead]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["u", "v", "u_n", "v_n"])


def _chains(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): within each list, the first set of each component with the first set of the next one."""
    for c in _lists(batches, ["token", "n", "pos", "node", "s", "root"]):
        token, n, s, root, node = c["token"], c["n"].astype(np.int64), c["s"], c["root"], c["node"]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        found = []
        for b, e in zip(begin, np.append(begin[1:], len(token)), strict=True):
            if (root[b:e] != root[b]).any():
                firsts = b + np.sort(np.unique(root[b:e], return_index=True)[1])
                found.append(np.stack((firsts[1:], firsts[:-1])))
        if found:
            later, earlier = np.concatenate(found, axis=1)
            near = (_kept(n[later], percent) <= n[earlier]) & (np.minimum(s[later], s[earlier]) >= _need(n[later], n[earlier], percent))
            yield pa.RecordBatch.from_arrays([pa.array(node[later[near]]), pa.array(node[earlier[near]])], ["u", "v"])


def _bounds(c: dict[str, np.ndarray], s: np.ndarray, n: np.ndarray, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest overlap of set i with each of j, from what both have and lack of one lead.

    Both lack a token of the lead only if both masks have its bit, and likewise for tokens that the lead hasn't.
    """

    def common(mask: str, of_i: int, of_j: np.ndarray) -> np.ndarray:
        a, b = c[mask][i], c[mask][j]
        return np.minimum(of_i - np.bitwise_count(a & ~b).astype(np.int64), of_j - np.bitwise_count(b & ~a).astype(np.int64))

    same = c["lead"][j] == c["lead"][i]
    a, o, lead_n = int(c["shared"][i]), c["shared"][j].astype(np.int64), int(c["lead_n"][i])
    inside = a + o - lead_n
    outside = np.minimum(common("more", int(n[i]) - a, n[j] - o), np.minimum(s[i] - a, s[j] - o))
    high = inside + common("lack", lead_n - a, lead_n - o) + outside
    return np.where(same, inside, -1), np.where(same, high, n[i])


def _pairs(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, u_n, v_n, votes, sure): pairs of different components that sizes, positions, shared tokens and leads leave open."""
    names = ["token", "n", "pos", "node", "s", "root", "lead", "shared", "lead_n", "lack", "more", *WORDS]
    for c in _lists(batches, names):
        token, n, pos, s, root, node = c["token"], c["n"].astype(np.int64), c["pos"].astype(np.int64), c["s"], c["root"], c["node"]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        end = np.append(begin[1:], len(token))
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for b, e in zip(begin, end, strict=True):
            if (root[b:e] == root[b]).all():
                continue
            sizes, firsts = np.unique(n[b:e], return_index=True)
            blocks = list(zip(sizes.tolist(), (b + firsts).tolist(), np.append(b + firsts[1:], e).tolist(), strict=True))
            for k, (small, a_lo, a_hi) in enumerate(blocks):
                for large, b_lo, b_hi in blocks[k:]:
                    if _kept(large, percent) > small:
                        break
                    # between two blocks the least overlap is one number; sets that share fewer tokens are skipped
                    need = _need(small, large, percent)
                    spare = votes_needed(small) - need
                    left = a_lo + np.flatnonzero((s[a_lo:a_hi] >= need) & (pos[a_lo:a_hi] < small + spare))
                    right = b_lo + np.flatnonzero((s[b_lo:b_hi] >= need) & (pos[b_lo:b_hi] < large + spare))
                    if not len(left) or not len(right):
                        continue
                    at = pos[right]
                    # before and behind these positions the token says nothing: both ends of the block are skipped
                    lows = np.searchsorted(at, pos[left] - small + need, side="left")
                    highs = np.searchsorted(at, pos[left] + large - need, side="right")
                    for i, lo, hi in zip(left, lows, highs, strict=True):
                        j = right[lo:hi]
                        j = j[(j > i) & (root[j] != root[i])]
                        differ = sum(np.bitwise_count(c[w][j] ^ c[w][i]).astype(np.int64) for w in WORDS)
                        j = j[differ <= small + large - 2 * need]
                        if not len(j):
                            continue
                        low, high = _bounds(c, s, n, i, j)
                        j, low = j[high >= need], low[high >= need]
                        for x, v in zip(found, (np.full(len(j), node[i]), node[j], np.full(len(j), small), np.full(len(j), large), low >= need), strict=True):
                            x.append(v)
        if found[0]:
            u, v, un, vn, sure = (np.concatenate(x) for x in found)
            swap = u > v
            u, v, un, vn = np.where(swap, v, u), np.where(swap, u, v), np.where(swap, vn, un), np.where(swap, un, vn)
            key, count = np.unique(np.stack((u, v, un, vn, sure.astype(np.int64))), axis=1, return_counts=True)
            cols = [*key[:4], count, key[4] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["u", "v", "u_n", "v_n", "votes", "sure"])


def _compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(u, v, shared, u_n, v_n, lack, more): tokens in both sets; masks of those that only v has, and that only u has.

    Sets of no pair are left out before they are shuffled.
    """
    pairs = stored(pairs.select("u", "v"))

    def side(end: str, tokens: str) -> DataFrame:
        ids = stored(pairs.select(F.col(end).alias("node")).distinct())
        held = whole.join(_sent(ids, ids.count()), "node", "left_semi")
        return held.select(F.col("node").alias(end), F.col("tokens").alias(tokens))

    both = pairs.join(side("u", "_a"), "u").join(side("v", "_b"), "v")
    return both.select(
        "u",
        "v",
        F.size(F.array_intersect("_a", "_b")).alias("shared"),
        F.size("_a").alias("u_n"),
        F.size("_b").alias("v_n"),
        _mask(F.array_except("_b", "_a")).alias("lack"),
        _mask(F.array_except("_a", "_b")).alias("more"),
    )


def _mask(tokens: Column) -> Column:
    """64 bits, of which each token sets one."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(bit(x)))


def _linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def link(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Sets are of ``shingle`` words, five at most; sets of ``percent`` similarity or more are linked,
    and chains of links are one component.

    Input: doc_id, text (other columns are ignored). Null, empty and blank texts have an empty
    set and are their own component. Repeated rows and equal sets are linked. A null doc_id
    never names a component unless all of its rows' ids are null. An empty table gives an
    empty result. Nodes are 64-bit digests of sets; tokens are 64-bit hashes of shingles.
    """
    if not 1 <= shingle <= len(_PLACES):
        raise ValueError(f"sets are of 1 to {len(_PLACES)} words, not {shingle}")
    parts = shuffle_partitions(docs.sparkSession)
    rows = stored(nodes_of(docs, shingle))
    filled = rows.filter(F.col("n") > 0)
    nodes = filled.groupBy("node", "n").agg(F.min("doc_id").alias("first_id"))
    buckets = max(1, parts // 4)
    entries = stored(lists(postings(docs, hot_tokens(docs, shingle), buckets, shingle, percent)))
    enough = lambda n: 1 + F.floor(n * 3 / 100)  # noqa: E731  votes_needed
    kept = F.ceil(F.col("n") * percent / 100)

    # sets that could have an answer: enough entries in lists, then enough tokens that are in other such sets
    met = entries.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("votes"))
    met = met.filter(F.col("votes") >= enough(kept)).select("node")
    found = stored(whole_sets(docs, stored(nodes.join(met, "node", "left_semi").select("node", "first_id")), shingle))
    tokens = found.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
    alive = found.select("node", F.size("tokens").alias("n")).distinct()
    alive = alive.join(shared_tokens(found, max(buckets, 1 + tokens // BLOCK_TOKENS)), "node")
    alive = stored(alive.filter(F.col("shared") >= kept).select("node", F.col("shared").cast("int").alias("s")))
    few = _sent(alive, alive.count())
    whole = stored(found.join(few, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")))
    entries = stored(entries.join(few, "node"))
    in_lists = lambda df: df.repartition(parts, "token").sortWithinPartitions("token", "n", "pos", "node")

    # one lead for each set: of those with enough prefix tokens in common, the one that most sets could have
    stars = in_lists(entries).mapInArrow(thrifty(partial(_leads, percent)), "u long, v long, u_n long, v_n long")
    stars = stars.groupBy("u", "v", "u_n", "v_n").agg(F.count("*").alias("votes"))
    stars = stored(stars.filter(F.col("votes") >= enough(F.least("u_n", "v_n"))).select("u", "v", "votes"))
    liked = stars.groupBy("v").agg(F.count("*").alias("liked"))
    own = liked.select(F.col("v").alias("u"), F.col("liked").alias("own"))
    chosen = stars.join(liked, "v").join(own, "u", "left").filter(F.coalesce("own", F.lit(0)) <= F.col("liked"))
    chosen = chosen.groupBy("u").agg(F.max(F.struct("liked", "votes", "v")).alias("m")).select("u", F.col("m.v").alias("v"))
    first = stored(_compared(chosen, whole))
    links = first.filter(_linked(F.col("shared"), F.col("u_n"), F.col("v_n"), percent)).select("u", "v")
    roots = stored(components(links))
    for _ in range(CHAIN_ROUNDS):
        mixed = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        chains = in_lists(mixed).mapInArrow(thrifty(partial(_chains, percent)), "u long, v long")
        votes = chains.groupBy("u", "v").agg(F.count("*").alias("votes"))
        best = votes.groupBy("u").agg(F.max(F.struct("votes", "v")).alias("m"))
        tried = _compared(best.select("u", F.col("m.v").alias("v")), whole)
        more = stored(tried.filter(_linked(F.col("shared"), F.col("u_n"), F.col("v_n"), percent)).select("u", "v"))
        if more.isEmpty():
            break
        links = stored(links.unionByName(more))
        roots = stored(components(links))

    known = first.select(F.col("u").alias("node"), F.col("v").alias("lead"), "shared", F.col("v_n").alias("lead_n"), "lack", "more")
    bits = stored(sketches(whole))
    open_ = entries.join(bits, "node").join(roots, "node", "left").join(known, "node", "left")
    open_ = open_.withColumns(
        {
            "root": F.coalesce("root", "node"),
            "lead": F.coalesce("lead", "node"),
            "shared": F.coalesce("shared", "n"),
            "lead_n": F.coalesce("lead_n", "n"),
            "lack": F.coalesce("lack", F.lit(0)),
            "more": F.coalesce("more", F.lit(0)),
        }
    )
    pairs = in_lists(open_).mapInArrow(thrifty(partial(_pairs, percent)), "u long, v long, u_n long, v_n long, votes long, sure boolean")
    pairs = pairs.groupBy("u", "v", "u_n", "v_n").agg(F.max("sure").alias("sure"), F.sum("votes").alias("votes"))
    pairs = stored(pairs.filter(F.col("sure") | (F.col("votes") >= enough(F.least("u_n", "v_n")))))
    checked = _compared(pairs.filter(~F.col("sure")), whole)
    more = checked.filter(_linked(F.col("shared"), F.col("u_n"), F.col("v_n"), percent)).select("u", "v")
    links = stored(links.unionByName(pairs.filter("sure").select("u", "v")).unionByName(more))
    roots = components(links)

    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("node", "component_id")
    whole_rows = filled.join(named, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    lone = rows.filter(F.col("n") == 0).select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return whole_rows.unionByName(lone)
