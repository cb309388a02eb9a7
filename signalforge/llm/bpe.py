"""Byte-level BPE: encoding texts by overlapping chunks, and decoding.

Texts are cut into overlapping chunks that are pre-tokenised each by itself. A chunk starts at
an arbitrary character, but the pattern looks only ahead, so once two chunks share a pre-token
boundary in their overlap they agree from there on. Neighbours are stitched at the first such
boundary behind a character that isn't white space: the pattern splits white space by what
follows it, so a piece that ends elsewhere could split otherwise by itself. Each stitched piece
is encoded where it lies, and a document's ids are its pieces' ids in order. Decoding
concatenates the bytes of the ids.

Chunks of ``CHUNK`` code points are worked on in the task that reads their text. Texts of over
``SPREAD`` are first cut into chunks of that length, which are dealt over all tasks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a chunk and of its overlap with the next one, for chunks of one task and for those dealt over tasks.
CHUNK, OVERLAP, SPREAD, SPREAD_OVERLAP = 2_048, 128, 32_768, 1_024
#: White space as Unicode defines it; the regex module's own class has four control characters more.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Texts to ids and back, by a rank file and the pattern that splits text before merges."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = pattern

    @cached_property
    def pretokens(self) -> regex.Pattern:
        white = self.pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        return regex.compile(white)

    @cached_property
    def white(self) -> frozenset[str]:
        return frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c))

    @cached_property
    def numerals(self) -> list[str]:
        return [str(i) for i in range(self.core.n_vocab)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        try:
            return self.core.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # the library's pattern engine gives up on very long runs
            ids = [i for m in self.pretokens.finditer(text) for i in self.core._encode_single_piece(m.group())]
            return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.core.decode_bytes(np.frombuffer(ids, "<u4").tolist())

    def starts(self, text: str) -> list[int]:
        """Where pre-tokens start, behind a character of ``text`` that isn't white space."""
        ends = accumulate(map(len, self.pretokens.findall(text)))  # pre-tokens cover the text
        return [e for e in ends if e < len(text) and text[e - 1] not in self.white]

    def encode_chunked(self, text: str, chunk: int, overlap: int) -> bytes:
        """The ids of ``encode``, by chunks; what follows an overlap without a common boundary is one piece."""
        n, ids, begin, tail = len(text), [], 0, set()
        for at in range(0, n, chunk):
            starts = [at + s for s in self.starts(text[at : at + chunk + overlap])]
            if at:
                end = min((s for s in starts if s <= at + overlap and s in tail), default=None)
                if end is None:
                    break
                ids.append(self.encode(text[begin:end]))
                begin = end
            tail = {s for s in starts if s >= at + chunk}
            if at + chunk + overlap >= n:
                break
        ids.append(self.encode(text[begin:]))
        return b"".join(ids)


@lru_cache(maxsize=1)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _digest(enc: Encoder, ids: bytes) -> tuple[int, str, str]:
    numbers = np.frombuffer(ids, "<u4").tolist()
    said = " ".join(map(enc.numerals.__getitem__, numbers)).encode()
    return len(numbers), hashlib.sha256(said).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()


def _short(ranks_path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            found = [_digest(enc, enc.encode_chunked(t.as_py(), chunk, overlap)) for t in batch.column("text")]
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(DIGEST)[1:], strict=True)]],
                schema=DIGEST,
            )

    return run


PART = "doc_id long, digest binary, chunk int, part string"


def _cut(chunk: int, overlap: int):
    """Chunks of each text; digest tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                whole = text.as_py()
                digest = hashlib.md5(whole.encode()).digest()
                for at in range(0, len(whole), chunk):
                    row = ([doc_id], [digest], [at // chunk], [whole[at : at + chunk + overlap]])
                    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["doc_id", "digest", "chunk", "part"])

    return run


BOUNDS = "doc_id long, digest binary, chunk int, copies long, part string, head array<int>, tail array<int>"


def _boundaries(ranks_path: str, pattern: str, chunk_chars: int, overlap: int):
    """Pre-tokenise each chunk; boundaries in the overlaps with the chunk before and after, in the document's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            heads, tails = [], []
            for k, part in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
                at = k * chunk_chars
                starts = [at + s for s in enc.starts(part.as_py())]
                heads.append([s for s in starts if s <= at + overlap])
                tails.append([s for s in starts if s >= at + chunk_chars])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], [*batch.schema.names, "head", "tail"]
            )

    return run


PIECE = "doc_id long, digest binary, copies long, chunk int, whole boolean, part string, ids binary"


def _pieces(ranks_path: str, pattern: str, chunk_chars: int, chunk: int, overlap: int):
    """Encode each stitched piece; chunks of a document without a stitch keep their own characters as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            parts, ids = [], []
            for r in batch.to_pylist():
                at = r["chunk"] * chunk_chars
                if r["whole"]:
                    parts.append(r["part"][:chunk_chars])
                    ids.append(b"")
                else:
                    end = len(r["part"]) if r["end"] is None else r["end"] - at
                    parts.append("")
                    ids.append(enc.encode_chunked(r["part"][(r["begin"] or at) - at : end], chunk, overlap))
            yield pa.RecordBatch.from_pydict(
                {k: batch.column(k) for k in ("doc_id", "digest", "copies", "chunk", "whole")}
                | {"part": pa.array(parts, pa.string()), "ids": pa.array(ids, pa.binary())}
            )

    return run


def _joined(ranks_path: str, pattern: str):
    """One document's digests; a digest reads its ids in order, so they meet in one task."""

    def run(table: pa.Table) -> pa.Table:
        enc = encoder(ranks_path, pattern)
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        whole = rows[0]["whole"]
        ids = enc.encode("".join(r["part"] for r in rows)) if whole else b"".join(r["ids"] for r in rows)
        found = [(rows[0]["doc_id"], *_digest(enc, ids))] * rows[0]["copies"]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), DIGEST, strict=True)], schema=DIGEST)

    return run


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    spread: int = SPREAD,
    spread_overlap: int = SPREAD_OVERLAP,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Input: doc_id, text (other columns are ignored). Null text counts as empty: no ids; a null
    doc_id stays null. Texts of at most ``spread`` code points are encoded by chunks in the task
    that reads them; the chunks of longer ones are dealt over tasks. Where an overlap has no
    common boundary (a run of over ``overlap`` letters, say), the rest of the text is encoded as
    one piece; a longer text with such an overlap, as a whole. Repeated rows stay repeated. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = rows.filter(F.length("text") <= spread).mapInArrow(_short(ranks_path, pattern, chunk, overlap), kind)
    chunks = rows.filter(F.length("text") > spread).mapInArrow(_cut(spread, spread_overlap), PART)
    chunks = chunks.groupBy("doc_id", "digest", "chunk").agg(F.count("*").alias("copies"), F.first("part").alias("part"))
    bounds = chunks.select("doc_id", "digest", "chunk", "copies", "part")
    bounds = bounds.mapInArrow(_boundaries(ranks_path, pattern, spread, spread_overlap), BOUNDS)
    doc = Window.partitionBy("doc_id", "digest")
    order = doc.orderBy("chunk")
    meet = lambda a, b: F.array_min(F.array_intersect(a, b))
    stitched = bounds.withColumns(
        {
            "begin": meet(F.lag("tail").over(order), F.col("head")),
            "end": meet(F.col("tail"), F.lead("head").over(order)),
            "last": F.lead("chunk").over(order).isNull(),
        }
    )
    lost = F.max((~F.col("last") & F.col("end").isNull()).cast("int")).over(doc) == 1
    stitched = stitched.withColumn("whole", lost)
    pieces = stitched.select("doc_id", "digest", "copies", "chunk", "whole", "part", "begin", "end")
    pieces = pieces.mapInArrow(_pieces(ranks_path, pattern, spread, chunk, overlap), PIECE)
    long = pieces.groupBy("doc_id", "digest").applyInArrow(_joined(ranks_path, pattern), kind)
    return short.unionByName(long)
