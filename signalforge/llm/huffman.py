"""Token ids in files of canonical, length-limited Huffman codes.

Counts of all ids give one code for the corpus. Code lengths come from the package-merge method
and are limited to ``MAX_BITS``, so that one table of 2 ** ``MAX_BITS`` entries decodes any code.
Codes are canonical: the lengths alone, which each file carries, say what they are.

A file holds the ids of consecutive documents in ascending order of doc_id. Its stream is cut
into blocks of ``BLOCK`` ids, and a checkpoint says at which bit each block starts, so blocks are
decoded independently, here all blocks of a file at once, one id of each in a step.

Null text is empty: its document has the end id only. Documents without an id come first, those
of one id in the order in which they were stored. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from signalforge.llm.common import shared_dir, stored

#: Longest code, ids of a block, of a piece that is encoded at once and of a file; the last two are whole blocks.
MAX_BITS, BLOCK, PIECE, FILE_IDS = 18, 512, 1 << 18, 1 << 21
#: Pieces whose ids a worker remembers in each of two generations, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 48
#: Pieces that the library gets in one text, and bytes of texts whose words are looked at together.
JOINED, TOGETHER = 200, 12_000_000
END_ID = 1
SUFFIX, MAGIC = ".ids", b"SFIDS001"
HEAD = struct.Struct("<8sIIQQQIBQQQ")


# -- tokens ---------------------------------------------------------------------------------------


class Words(dict):
    """Ids of pieces, as bytes; a piece that isn't held is encoded by the library and remembered.

    The pre-tokeniser drops white space and looks neither ahead nor back, and normalisation works
    character by character within a chunk between ASCII white space, so a text's ids are its chunks'
    ids in order. Each different chunk of a batch is looked at once. Chunks of letters, digits and
    signs below U+0180 are lowered and split into pieces by Arrow, which saves the library's pattern
    engine; any other is one piece, marked by ``WHOLE``, and goes through the library as it stands.
    """

    #: Letters and numbers below U+0180, where Unicode's classes are settled; U+0130 grows when it is lowered.
    LETTERS, NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
    #: No sign of a chunk that is split.
    WHOLE = "\0"

    def __init__(self, path: str, kind: str):
        super().__init__()
        self.library, self.kind, self.older = Tokenizer.from_file(path), kind, {}
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain = "^[\x21-\x7e\xa1-įı-ſ]*$"
        self.split = f"('s|'t|'re|'ve|'m|'ll|'d|[{self.NUMBERS}]|[^{self.LETTERS}{self.NUMBERS}]+)"
        self.merger = Tokenizer(self.library.model)  # takes shown pieces with a space between
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        plainly = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in plainly]
        self.signs = {b: chr(b) for b in plainly} | {b: chr(256 + i) for i, b in enumerate(hidden) if b != 32}

    def shown(self, pieces: str) -> str:
        """The library's signs for the bytes of pieces; a space stays one."""
        return pieces if pieces.isascii() else pieces.encode().decode("latin-1").translate(self.signs)

    def encoded(self, pieces: list[str]) -> list[bytes]:
        out, short, width = [b""] * len(pieces), [], np.dtype(self.kind).itemsize
        for k, p in enumerate(pieces):
            if p.startswith(self.WHOLE):
                out[k] = np.array(self.library.encode(p[1:], add_special_tokens=False).ids, self.kind).tobytes()
            elif len(p) > LONGEST:  # joined ones cost more memory
                out[k] = np.array([t.id for t in self.library.model.tokenize(self.shown(p))], self.kind).tobytes()
            elif p:
                short.append(k)
        for at in range(0, len(short), JOINED):
            own = short[at : at + JOINED]
            found = self.merger.encode(self.shown(" ".join([pieces[k] for k in own])), add_special_tokens=False)
            raw, start = np.array(found.ids, self.kind).tobytes(), 0
            for k, end in zip(own, (np.bincount(found.word_ids).cumsum() * width).tolist(), strict=True):
                out[k], start = raw[start:end], end
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces that come again move from the older generation to the newer; when that is full, the older one goes."""
        ids = list(map(self.get, pieces))
        lost = [k for k, x in enumerate(ids) if x is None]
        for k in lost:
            ids[k] = self.older.pop(pieces[k], None)
        new = [k for k in lost if ids[k] is None]
        for k, x in zip(new, self.encoded([pieces[k] for k in new]), strict=True):
            ids[k] = x
        for k in lost:
            if len(pieces[k]) <= LONGEST:
                if len(self) >= REMEMBERED:
                    self.older = dict(self)
                    self.clear()
                self[pieces[k]] = ids[k]
        return ids

    def chunks(self, chunks: pa.Array) -> pa.Array:
        chunks = chunks.cast(pa.large_string())  # spaces between digits make a chunk three times as long
        plain = pc.match_substring_regex(chunks, self.plain)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(chunks, token))
        spaced = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks), self.split, r" \1 "))
        marked = pc.binary_join_element_wise(pa.scalar(self.WHOLE, pa.large_string()), chunks, pa.scalar("", pa.large_string()))
        return through(pc.if_else(plain, spaced, marked), lambda x: pa.array(self.pieces(x.to_numpy(zero_copy_only=False).tolist()), pa.binary()))

    def texts(self, texts: pa.Array) -> pa.Array:
        return through(pc.ascii_trim_whitespace(texts), self.chunks)

    def of(self, text: bytes) -> bytes:
        return self.texts(pa.array([text.decode()]))[0].as_py()


def through(texts: pa.Array, ids: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Ids of texts, from those of their different parts between white space; an empty text has the part ``""``."""
    parts = pc.ascii_split_whitespace(texts)
    each = parts.flatten().dictionary_encode()
    return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids(each.dictionary).take(each.indices)), b"")


_WORDS: dict[tuple[str, str], Words] = {}


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, ids): every document's ids with the closing one, packed in as many bytes as the vocabulary needs."""
    kind = id_kind(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.setdefault((path, kind), Words(path, kind)) if (path, kind) not in _WORDS else _WORDS[path, kind]
        close, width = np.array([END_ID], kind).tobytes(), np.dtype(kind).itemsize
        for batch in together(batches):
            ids = pc.binary_join_element_wise(words.texts(batch.column("text")), close, b"")
            n = pc.divide(pc.binary_length(ids).cast(pa.int64()), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, ids], ["doc_id", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``TOGETHER`` bytes at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def id_kind(path: str) -> str:
    """The narrowest type that holds every id of the vocabulary."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab(True).values()) < 1 << 16 else "<u4"


def counts_of(rows: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all rows; the driver sees one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            found[: len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    total[found["id"].to_numpy()] = found["n"].to_numpy()
    return total


# -- code -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each id's code, 0 for ids that don't occur: the cheapest code of at most ``most`` bits (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << most:
        raise ValueError(f"{n} ids can't have codes of {most} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    packages, leaf = np.zeros(0, np.int64), []
    for _ in range(most):
        both = np.concatenate((weights, packages))
        at = np.argsort(both, kind="stable")
        leaf.append(np.cumsum(at < n))
        merged = both[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for leaves in reversed(leaf):
        if take == 0:
            break
        held = int(leaves[take - 1])
        lengths[order[:held]] += 1
        take = 2 * (take - held)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each id, ids in the order of their codes): by length, then by id."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes = np.zeros(len(lengths), np.uint64)
    if len(ids):
        most = int(lengths[ids[-1]])
        steps = np.uint64(1) << (most - lengths[ids].astype(np.int64)).astype(np.uint64)
        starts = np.cumsum(steps) - steps
        codes[ids] = starts >> (most - lengths[ids].astype(np.int64)).astype(np.uint64)
    return codes, ids


def packed(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the codes of ids, end to end, filled up to whole 64-bit words, bit at which each block starts)."""
    width, code = lengths[ids], codes[ids]
    if len(ids) % 2:
        width, code = np.append(width, np.uint8(0)), np.append(code, np.uint64(0))
    code = code[::2] << width[1::2] | code[1::2]  # two codes are placed at once
    width = width[::2].astype(np.int64) + width[1::2]
    ends = np.cumsum(width)
    at = ends - width
    room = 64 - (at & 63) - width
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    word = at >> 6
    first = np.flatnonzero(np.diff(word, prepend=-1))  # two codes are shorter than words, so some start in each
    out = np.zeros(int(ends[-1] + 63 >> 6), np.uint64)
    out[: len(first)] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[:: BLOCK // 2]


def unpacked(payload: bytes, marks: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The n ids of a payload whose blocks start at the bits ``marks``."""
    if n == 0:
        return np.zeros(0, np.uint32)
    out = np.zeros((BLOCK, len(marks)), np.uint32)
    _, order = canonical(lengths)
    most = int(lengths.max())
    spread = 1 << (most - lengths[order].astype(np.int64))
    table = np.ones(1 << most, np.uint32)  # of each window of bits: the id, and below it five bits for its code's length
    table[: spread.sum()] = np.repeat(order.astype(np.uint32) << 5 | lengths[order], spread)
    raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, mask, last = marks.astype(np.int64), np.uint32((1 << most) - 1), n - (len(marks) - 1) * BLOCK
    for k in range(BLOCK if len(marks) > 1 else last):
        if k == last:
            at = at[:-1]  # the last block is shorter
        found = table[words[at >> 3] >> (32 - most - (at & 7)).astype(np.uint32) & mask]
        out[k, : len(at)] = found >> 5
        at = at + (found & 31)
    return out.T.reshape(-1)[:n]


# -- files ----------------------------------------------------------------------------------------


def to_file(part: int, seq: int, start: int, doc_ids: list, ns: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file: head, code lengths, documents (null flags, ids, counts), checkpoints, payload and a checksum of all that."""
    payloads, marks, size = [], [], 0
    for at in range(0, len(ids), PIECE):
        payload, found = packed(ids[at : at + PIECE], codes, lengths)
        payloads.append(payload)
        marks.append(found + size * 8)
        size += len(payload)
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    held = np.array([0 if i is None else i for i in doc_ids], "<i8")
    parts = [zlib.compress(lengths.tobytes(), 6), zlib.compress(nulls.tobytes() + held.tobytes() + ns.astype("<u8").tobytes(), 1)]
    parts.append(zlib.compress(np.concatenate(marks).astype("<u8").tobytes() if marks else b"", 1))
    head = HEAD.pack(MAGIC, part, seq, start, len(doc_ids), len(ids), BLOCK, MAX_BITS, *map(len, parts))
    whole = b"".join((head, *parts, *payloads))
    return whole + struct.pack("<I", zlib.crc32(whole))


def from_file(data: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """(part, start in the part, doc_ids, counts, ids) of a file."""
    if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole file of ids")
    _, part, _, start, docs, n, block, _, *sizes = HEAD.unpack_from(data)
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    at, parts = HEAD.size, []
    for size in sizes:
        parts.append(zlib.decompress(data[at : at + size]))
        at += size
    lengths, marks = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[2], "<u8")
    held, ns = np.frombuffer(parts[1], "<i8", docs, docs), np.frombuffer(parts[1], "<u8", docs, 9 * docs)
    doc_ids = [None if null else i for null, i in zip(parts[1][:docs], held.tolist(), strict=True)]
    return part, start, doc_ids, ns.astype(np.int64), unpacked(data[at:-4], marks, n, lengths)


def _put(folder: str, name: str, data: bytes) -> None:
    """A file in its place at once: a lost or repeated task leaves no half of it, and any other attempt has the same bytes."""
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(path)
    own = f"{path}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{path}/{name}")


def write(rows: DataFrame, kind: str, counts: np.ndarray, folder: str) -> DataFrame:
    """Write files of ``rows`` (doc_id, n, ids) in ascending order of doc_id; (part, seq, n_docs, n_ids, n_bytes) of each file.

    Files of one part follow each other, and so do parts. A part has about ``FILE_IDS`` ids; rows
    of one id may be many and are dealt over parts by their place in ``rows``, a stored table.
    """
    lengths = code_lengths(counts)
    codes, _ = canonical(lengths)
    code = rows.sparkSession.sparkContext.broadcast((codes, lengths))  # as many numbers as the vocabulary has ids
    parts = max(1, math.ceil(int(counts.sum()) / FILE_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, size, doc_ids, ids = None, 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, size, doc_ids, ids
            ns = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
            data = to_file(part, seq, start, doc_ids, ns, np.frombuffer(b"".join(ids), kind), *code.value)
            _put(folder, f"{part:08d}-{seq:06d}{SUFFIX}", data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(doc_ids), "n_ids": int(ns.sum()), "n_bytes": len(data)}], SHAPE)
            start, seq, size, doc_ids, ids = start + int(ns.sum()), seq + 1, 0, [], []
            return row

        for batch in batches:
            for i, n, x, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "part")), strict=True):
                doc_ids.append(i)
                ids.append(x)
                size += n
                if size >= FILE_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, F.asc_nulls_first("doc_id"), "at")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), "at").withColumn("part", F.spark_partition_id())
    return ordered.select("doc_id", "n", "ids", "part").mapInArrow(run, "part int, seq int, n_docs long, n_ids long, n_bytes long")


SHAPE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def read(df: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files in ``folder``; ``files`` is what ``write`` returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                part, start, doc_ids, ns, ids = from_file(data.as_py())
                ends = np.cumsum(ns)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), ns.tolist(), strict=True)]
                cols = [doc_ids, [part] * len(ns), start + ends - ns, ns, crc]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "own_start", "n_tokens", "ids_crc32"])

    held = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    found = held.mapInArrow(run, "doc_id long, part int, own_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return found.join(starts, "part").select("doc_id", (F.col("own_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def through_files(docs: DataFrame, path: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the files in the shared folder and read them back."""
    spark, kind = docs.sparkSession, id_kind(path)
    rows = stored(tokenised(docs, path))
    counts = counts_of(rows, kind)
    if not counts.sum():
        return spark.createDataFrame([], READ)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    files = stored(write(rows, kind, counts, folder))
    return read(docs, files, folder)
