"""Removal of passages repeated from earlier documents, by bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a
smaller id. Every such string has a minimizer, its ``KMER``-byte substring of least hash, so
equal strings have equal minimizers: texts are cut into runs of strings that share one, and
runs are dealt into buckets by it. A bucket drops what no other document can match, keeps each
distinct run once, and builds the suffix order and the Burrows-Wheeler transform of the rest.

On it, breadth-first backward extension takes the intervals of all strings of length 1, 2, ...
and so finds the places in the suffix order where neighbours share exactly 0, 1, ... bytes. It
stops at ``SPAN``: places not found by then lie within groups of suffixes that share ``SPAN``
bytes or more, and the least document of each group decides which of its strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.llm.common import NO_ID, free, give_back, shuffle_partitions, thrifty, thrifty_group

SPAN, KMER = 50, 8
#: Bytes of text for each bucket, of text worked on at once, of text behind each shuffled block, and of runs in a transform.
BUCKET_BYTES, STEP_BYTES, BLOCK_BYTES, TRANSFORM_BYTES = 10 << 20, (1 << 17) - 64, 12 << 20, 1 << 19
#: Bytes of packed blocks in a batch that a worker sends.
SENT_BYTES = 4 << 20
#: Runs hashed or gathered at once.
HASH_ROWS = 1 << 13
#: A window reaches this far on at least one side of its minimizer's start or end.
_SIDE = (SPAN - KMER) // 2
_LONGEST = 2 * SPAN - KMER
_PLACE_BITS = np.uint64(20)
_PLACE = np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ROW = np.random.default_rng(7).integers(1, 2**63, (2, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(32))


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, place of the minimizer, key) of each run of strings with one minimizer.

    raw: texts one after another, at most 2**20 bytes; ends: where each one ends. Strings don't
    cross texts. What a run is depends on its own bytes only.
    """
    n = len(raw) - SPAN + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = raw.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < KMER:
        h = h[:-width] * (_A + np.uint64(2 * width)) + h[width:]
        width *= 2
    m = (_mixed(h) & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    want, width = SPAN - KMER + 1, 1
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (want - width)], m[want - width :]) if want > width else m
    # strings that run past the end of their text
    outside = np.zeros(n + 1, np.int32)
    last = ends[:-1]
    np.add.at(outside, np.clip(last - SPAN + 1, 0, n), 1)
    np.add.at(outside, np.clip(last, 0, n), -1)
    inside = np.cumsum(outside[:n]) == 0
    new = np.concatenate(([True], m[1:] != m[:-1]))
    new[1:] |= inside[1:] != inside[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    ok = inside[begin]
    begin, end = begin[ok], end[ok]
    least = m[begin]
    return begin, end - begin + SPAN - 1, (least & _PLACE).astype(np.int64) - begin, _mixed(least >> _PLACE_BITS)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(blob: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(data[at : at + size], k))
        at += size
    return [*out, np.frombuffer(data[at:], np.uint8)]


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
RUN_KINDS = ["i8", "u4", "u4", "u1", "u1"]
SPAN_KINDS = ["i8", "u4", "u4", "u4"]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... of each of the lengths, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)


def _cut(buckets: int):
    """Blocks of runs: one row per bucket for every ``BLOCK_BYTES`` of text, sent by about ``SENT_BYTES``."""

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "n", "runs"])

    def block(columns: list[np.ndarray], raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, doc, digest, pos, size, off, at = columns
        order = np.argsort(bucket, kind="stable").astype("i4")
        last = np.cumsum(np.bincount(bucket))
        found = np.flatnonzero(np.diff(last, prepend=0))
        rows: list[tuple] = []
        ready = 0
        for b, lo, hi in zip(found, np.append(0, last[found[:-1]]), last[found], strict=True):
            o = order[lo:hi]
            rows.append((int(b), len(o), _packed(doc[o], digest[o], pos[o], size[o], off[o], _only(raw, at[o], size[o]))))
            ready += len(rows[-1][2])
            if ready >= SENT_BYTES:
                yield sent(rows)
                rows, ready = [], 0
        if rows:
            yield sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one set of arrays for all blocks of a task, as long as one run for each byte; what isn't written takes no memory
        most = BLOCK_BYTES + 2 * STEP_BYTES + SPAN
        columns, texts = [np.empty(most, k) for k in ("i4", *RUN_KINDS, "i4")], np.empty(most, np.uint8)
        n = size = 0
        for batch in batches:
            for ids, digests, bases, raw, ends in _steps(batch):
                start, length, off, key = runs(raw, ends)
                of = np.searchsorted(ends, start, side="right")
                begin = np.concatenate(([0], ends[:-1]))
                bucket = key % np.uint64(buckets)
                new = bucket, ids[of], digests[of], start - begin[of] + bases[of], length, off, start + size
                for x, part in zip(columns, new, strict=True):
                    x[n : n + len(part)] = part
                texts[size : size + len(raw)] = raw
                n, size = n + len(start), size + len(raw)
                if size >= BLOCK_BYTES:
                    yield from block([x[:n] for x in columns], texts[:size])
                    n = size = 0
        if size:
            yield from block([x[:n] for x in columns], texts[:size])

    return thrifty(run)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(ids, digests, first byte's place in its text, bytes, ends) of about ``STEP_BYTES``; long texts in overlapping parts."""
    ids, digests = batch.column("_id").to_pylist(), batch.column("_digest").to_pylist()
    held: list[tuple] = []
    size = 0

    def step() -> tuple:
        parts = [h[3] for h in held]
        return (
            np.array([h[0] for h in held], np.int64),
            np.array([h[1] for h in held], np.int64),
            np.array([h[2] for h in held], np.int64),
            np.frombuffer(b"".join(parts), np.uint8),
            np.cumsum([len(p) for p in parts]),
        )

    for i, d, text in zip(ids, digests, batch.column("text").cast(pa.binary()), strict=True):
        raw = text.as_py()
        for base in range(0, max(1, len(raw) - SPAN + 1), STEP_BYTES):
            part = raw[base : base + STEP_BYTES + SPAN - 1]
            if len(part) >= SPAN:
                held.append((i, d, base, part))
                size += len(part)
                if size >= STEP_BYTES:
                    yield step()
                    held, size = [], 0
    if held:
        yield step()


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose key also has a row of another document."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    mixed = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(mixed, np.diff(np.append(first, len(k))))
    return out


def _hashed(raw: np.ndarray, at: np.ndarray, size: np.ndarray | int, width: int, row: int) -> np.ndarray:
    """Hash of ``size`` bytes from each place, padded to ``width``, a multiple of 8."""
    out = np.empty(len(at), np.uint64)
    sizes = np.broadcast_to(np.asarray(size), (len(at),))
    for lo in range(0, len(at), HASH_ROWS):
        a, n = at[lo : lo + HASH_ROWS], sizes[lo : lo + HASH_ROWS]
        held = raw[np.minimum(a[:, None] + np.arange(width), len(raw) - 1)]
        held = np.where(np.arange(width) < n[:, None], held, 0).astype(np.uint8)
        x = held.view(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * _ROW[row, : width // 8]
        total = (x ^ (x >> np.uint64(32))).sum(1, dtype=np.uint64)
        out[lo : lo + HASH_ROWS] = _mixed(total + n.astype(np.uint64) * _A)
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of symbols below 512 in order of at least their first ``_LONGEST`` + 1 symbols, ties by place."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, text.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64)))
        if depth > _LONGEST or new.sum() == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) + 1
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - depth)] = rank[depth:]
        key = rank * (n + 2) + behind
        depth *= 2


def boundaries(text: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Places in the suffix order before which neighbours share fewer than ``span`` symbols.

    Symbol 0 separates strings and is never extended over. Breadth-first backward extension:
    an interval of suffixes that start with w gives, for each symbol c before them, the
    interval of c + w; its end is a place of common prefix len(w), unless a shorter one was found there.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    bwt = np.where(before >= 0, text[before], 0)
    step = np.where(before >= 0, place[before], -1)
    found = np.zeros(n + 1, bool)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(span):
        size = hi - lo
        at = _ragged(lo, size)
        of = np.repeat(np.arange(len(lo)), size)
        real = bwt[at] > 0
        at, of = at[real], of[real]
        to = step[at]
        by = np.argsort(to)
        to, kind = to[by], of[by] * 512 + bwt[at[by]]
        if not len(to):
            break
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~found[high]
        found[high[fresh]] = True
        lo, hi = low[fresh], high[fresh]
        if not len(lo):
            break
    return found


def _near(raw: np.ndarray, at: np.ndarray, size: np.ndarray, off: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Runs that may share a string with a run of another owner.

    Around its minimizer a string has ``_SIDE`` bytes or more on one side at least, so runs
    with a string in common agree there.
    """
    near = np.zeros(len(at), bool)
    right = np.flatnonzero(size - off >= KMER + _SIDE)
    near[right] |= _shared(_hashed(raw, (at + off)[right], KMER + _SIDE, 40, 0), owner[right])
    left = np.flatnonzero(off >= _SIDE)
    near[left] |= _shared(_hashed(raw, (at + off)[left] - _SIDE, KMER + _SIDE, 40, 1), owner[left])
    return near


def least_documents(
    raw: np.ndarray, at: np.ndarray, size: np.ndarray, off: np.ndarray, doc: np.ndarray, key: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For distinct runs: least document of each of their strings, and where each run's strings begin.

    doc: least document of each run; key: its minimizer. A run that no other distinct run can
    share a string with needs no transform. The others are transformed together with all of
    their minimizer's, several minimizers at a time.
    """
    strings = size - SPAN + 1
    begins = np.cumsum(strings) - strings
    least = np.repeat(doc, strings)
    several = np.flatnonzero(_near(raw, at, size, off, np.arange(len(at))))
    several = several[np.argsort(key[several], kind="stable")]
    if not len(several):
        return least, begins
    new = np.flatnonzero(np.concatenate(([True], key[several][1:] != key[several][:-1])))
    upto = np.concatenate(([0], np.cumsum(size[several])))
    first = 0
    for hi in np.append(new[1:], len(several)):
        if hi < len(several) and upto[hi] - upto[first] < TRANSFORM_BYTES:
            continue
        _transformed(raw, at, size, several[first:hi], begins, strings, least)
        first = hi
    return least, begins


def _transformed(raw, at, size, chosen, begins, strings, least) -> None:
    """Put the least document of each string of the chosen runs into ``least``."""
    n = size[chosen] + 1
    text = np.zeros(int(n.sum()), np.int16)
    start = np.cumsum(n) - n
    text[_ragged(start, size[chosen])] = raw[_ragged(at[chosen], size[chosen])].astype(np.int16) + 1
    order = suffix_order(text)
    group = np.cumsum(boundaries(text, order, SPAN)[: len(text)])
    whole = np.full(len(text), -1, np.int64)
    whole[_ragged(start, strings[chosen])] = _ragged(begins[chosen], strings[chosen])
    of = whole[order]
    real = of >= 0
    group, of = group[real], of[real]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    best = np.minimum.reduceat(least[of], first)
    least[of] = np.repeat(best, np.diff(np.append(first, len(of))))


def _only(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some runs, one after another."""
    out = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    done = 0
    for lo in range(0, len(at), HASH_ROWS):
        part = raw[_ragged(at[lo : lo + HASH_ROWS].astype(np.int64), size[lo : lo + HASH_ROWS].astype(np.int64))]
        out[done : done + len(part)] = part
        done += len(part)
    return out


def _gathered(table: pa.Table) -> list[np.ndarray]:
    """The runs of a bucket's blocks, one block unpacked at a time into arrays of the whole bucket."""
    counts, blobs = table.column("n").to_pylist(), table.column("runs")
    each = sum(np.dtype(k).itemsize for k in RUN_KINDS)
    text = sum(zstandard.frame_content_size(b.as_py()) - each * n for b, n in zip(blobs, counts, strict=True))
    out = [np.empty(sum(counts), k) for k in RUN_KINDS] + [np.empty(text, np.uint8)]
    row = byte = 0
    for blob, n in zip(blobs, counts, strict=True):
        *columns, raw = _unpacked(blob.as_py(), n, RUN_KINDS)
        for x, part in zip(out, columns, strict=False):
            x[row : row + n] = part
        out[-1][byte : byte + len(raw)] = raw
        row, byte = row + n, byte + len(raw)
    return out


def _matched(homes: int):
    """Spans to remove, for each bucket: one row per home of the documents."""

    def run(table: pa.Table) -> pa.Table:
        doc, digest, pos, size, off, raw = _gathered(table)
        at = np.cumsum(size, dtype=np.int64) - size
        key = _hashed(raw, at + off, KMER, KMER, 0)
        keep = np.flatnonzero(_shared(key, doc))
        near = _near(raw, at[keep], size[keep].astype(np.int64), off[keep].astype(np.int64), doc[keep])
        keep = keep[near]
        doc, digest, key = doc[keep], digest[keep], key[keep]
        pos, size, off = (x[keep].astype(np.int64) for x in (pos, size, off))
        raw, at = _only(raw, at[keep], size), np.cumsum(size) - size
        if len(keep):
            a, b = _hashed(raw, at, size, 96, 0), _hashed(raw, at, size, 96, 1)
            order = np.lexsort((doc, b, a))
            new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
            one = order[np.flatnonzero(new)]  # the occurrence in the least document
            of = np.empty(len(keep), np.int64)
            of[order] = np.cumsum(new) - 1
            least, begins = least_documents(raw, at[one], size[one], off[one], doc[one], key[one])
            strings = size - SPAN + 1
            gone = least[_ragged(begins[of], strings)] < np.repeat(doc, strings)
            where = _ragged(np.zeros(len(keep), np.int64), strings)
            row = np.repeat(np.arange(len(keep)), strings)
            first = where == 0
            start = np.flatnonzero(gone & (first | ~np.append(False, gone[:-1])))
            last = np.flatnonzero(gone & (np.append(first[1:], True) | ~np.append(gone[1:], False)))
            spans = (doc[row[start]], digest[row[start]], pos[row[start]] + where[start], pos[row[start]] + where[last] + SPAN)
        else:
            spans = (np.empty(0, np.int64),) * 4
        home = (spans[0] ^ (spans[0] >> 17) ^ spans[1].astype(np.int64)) % homes
        rows = []
        for h in np.unique(home):
            o = np.flatnonzero(home == h)
            rows.append((int(h), len(o), _packed(*[s[o].astype(k) for s, k in zip(spans, SPAN_KINDS, strict=True)])))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["_home", "n", "spans"])

    return thrifty_group(run)


def _cleaned(inner: tuple[str, str, str], _: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Documents of one home without their spans; inner: the names of id, digest and home."""
    own_id, own_digest, _home = inner
    parts = [_unpacked(b, n, SPAN_KINDS) for b, n in zip(spans.column("spans").to_pylist(), spans.column("n").to_pylist(), strict=True)]
    doc, digest, start, stop = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(4))
    start, stop = start.astype(np.int64), stop.astype(np.int64)
    order = np.lexsort((digest, doc))
    doc, digest, start, stop = doc[order], digest[order], start[order], stop[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])))) if len(doc) else []
    at = {(int(doc[a]), int(digest[a])): (a, b) for a, b in zip(new, np.append(new[1:], len(doc)), strict=True)} if len(doc) else {}
    out: list[list] = [[], [], [], [], []]
    for i, d, text in zip(docs.column(own_id).to_pylist(), docs.column(own_digest).to_pylist(), docs.column("text").cast(pa.binary()), strict=True):
        raw = text.as_py()
        kept, n_spans = raw, 0
        if (i, d) in at:
            a, b = at[i, d]
            change = np.zeros(len(raw) + 1, np.int32)
            np.add.at(change, start[a:b], 1)
            np.add.at(change, stop[a:b], -1)
            gone = np.cumsum(change[:-1]) > 0
            n_spans = int(np.sum(gone[1:] & ~gone[:-1]) + gone[0])
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        for x, v in zip(out, (len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")), strict=True):
            x.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    cols = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
    rest = [c for c in docs.column_names if c not in (*inner, "text")]
    give_back()
    return pa.Table.from_arrays([*[docs.column(c) for c in rest], *cols], [*rest, *ADDED])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 and kept_text to every row, in place of text.

    Input: doc_id, text and any other columns, which stay. Null text has no bytes. A null
    doc_id is smaller than any other. Rows of equal doc_id never take from each other, but all
    take from smaller ids alike. kept_text leaves out characters that lost some of their bytes;
    kept_sha256 is of the bytes. An empty table gives an empty result. Columns named like those
    that are added are replaced. The least long can't be told from a null id.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    kept = docs.drop(*ADDED)
    inner = own_id, own_digest, home = tuple(free(c, kept.columns) for c in ("_id", "_digest", "_home"))
    rows = kept.withColumns({"text": text, own_id: F.coalesce("doc_id", F.lit(NO_ID)).cast("long"), own_digest: F.crc32(text.cast("binary"))})
    cut = rows.select(F.col(own_id).alias("_id"), F.col(own_digest).alias("_digest"), "text").mapInArrow(_cut(buckets), "bucket int, n int, runs binary")
    spans = cut.groupBy("bucket").applyInArrow(_matched(buckets), "_home long, n int, spans binary")
    homed = rows.withColumn(home, _home(F.col(own_id), F.col(own_digest), buckets))
    kind = kept.drop("text").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    kind = kind.add("kept_sha256", "string").add("kept_text", "string")
    clean = partial(_cleaned, inner)
    return homed.groupBy(home).cogroup(spans.groupBy("_home")).applyInArrow(lambda k, a, b: clean(k, a, b), kind)


def _home(doc_id: Column, digest: Column, homes: int) -> Column:
    """The group of documents that a document is cleaned with; ``_matched`` works out the same."""
    return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 17)).bitwiseXOR(digest), F.lit(homes)).cast("long")
