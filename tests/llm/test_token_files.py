"""Files of token ids: exact round trips, codes against a heap, and the library's own ids."""

from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalforge.llm import huffman
from signalforge.llm import queries as llm_queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    r, words = random.Random(1), huffman.Words(PATH, "<u2")
    signs = [chr(i) for i in range(1, 0x190)] + list("'stremvld  aé́　ΣσİıKÅ中文😀​\x1c\x85ﬁǅͅ") * 4
    signs += ["<|endoftext|>", "'S", "'Re", "don't", "\r\n"]
    for _ in range(8000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(words.of(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_worker_forgets(monkeypatch, library):
    monkeypatch.setattr(huffman, "REMEMBERED", 5)
    words = huffman.Words(PATH, "<u4")
    for k in range(3):
        for text in ("one two three four five six seven", "a" * 500, f"word{k}"):
            assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(words) <= 5


def test_a_piece_is_encoded_once():
    words = huffman.Words(PATH, "<u2")
    texts = ["Word, word. WORD! Word. word,", "word! (Word) , .", "wörd,"]
    one_by_one = [huffman.Words(PATH, "<u2").of(t.encode()) for t in texts]
    assert [words.of(t.encode()) for t in texts] == one_by_one
    assert set(words) == {"word", ",", ".", "!", "(", ")", "wörd"}  # not each of the chunks that they stand in


def test_texts_of_a_batch_are_the_librarys(library):
    r, words = random.Random(4), huffman.Words(PATH, "<u2")
    signs = [chr(i) for i in range(0x190)] + list("aé́Σ中\0\0  \n\t") * 4
    signs += ["<|endoftext|>", "'Re", "don't", "WORLD, ", "hello", "q" * 60, "é" * 60, " " + "z" * 49 + "!"]
    texts = ["", " ", "\0", "\0a", "a\0", *("".join(r.choices(signs, k=r.choice((1, 3, 20, 200)))) for _ in range(500))]
    for batch in (pa.array(texts), pa.array(["x", *texts]).slice(1)):  # the second time all are remembered
        found = [np.frombuffer(x, "<u2").tolist() for x in words.texts(batch).to_pylist()]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.texts(pa.array([], pa.string())).to_pylist() == []


def test_batches_are_taken_together(monkeypatch):
    monkeypatch.setattr(huffman, "TOGETHER", 100)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["t" * size]}) for k, size in enumerate((5, 0, 200, 1, 1))]
    found = [b.column("doc_id").to_pylist() for b in huffman.together(iter(batches))]
    assert found == [[0, 1, 2], [3, 4]] and list(huffman.together(iter([]))) == []


@pytest.mark.parametrize("n", [1, 2, 3, 50, 700])
def test_codes_are_cheapest_and_decode(n):
    r = np.random.default_rng(n)
    counts = r.geometric(0.01, n).astype(np.int64)
    counts[r.random(n) < 0.2] = 0
    counts[0] = 5
    lengths = huffman.code_lengths(counts, 22)
    used = counts > 0
    assert ((lengths > 0) == used).all() and lengths.max() <= 22
    if used.sum() > 1:
        assert sum(2.0 ** -lengths[used].astype(float)) == 1
        heap, cost = counts[used].tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((lengths * counts).sum()) == cost  # so many bits are not reached here
    codes, _ = huffman.canonical(lengths)
    for size in (1, 511, 512, 513, 5000):
        ids = r.choice(n, size, p=counts / counts.sum())
        payload, marks = huffman.packed(ids, codes, lengths)
        assert (huffman.unpacked(payload, marks, size, lengths) == ids).all()
        block = marks[-1:]
        rest = size - (len(marks) - 1) * huffman.BLOCK
        assert (huffman.unpacked(payload, block, rest, lengths) == ids[-rest:]).all()  # a block by itself


def brute_lengths(counts, most):
    """Least cost of prefix codes of at most ``most`` bits, by trying all multisets of lengths."""
    best = [float("inf")]

    def go(k, left, cost, shortest):
        if k == len(counts):
            best[0] = min(best[0], cost)
            return
        for n in range(shortest, most + 1):
            if left >= 2.0**-n:
                go(k + 1, left - 2.0**-n, cost + n * counts[k], n)

    go(0, 1.0, 0, 1)
    return best[0]


def test_limited_codes_are_cheapest():
    r = random.Random(3)
    for _ in range(40):
        counts = sorted((int(1.9 ** r.randint(0, 12)) for _ in range(r.randint(2, 8))), reverse=True)
        lengths = huffman.code_lengths(np.array(counts), 4)
        assert int((lengths.astype(int) * counts).sum()) == brute_lengths(counts, 4)
    assert len(huffman.code_lengths(np.zeros(0, np.int64))) == 0
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_files_say_if_they_are_broken():
    lengths = huffman.code_lengths(np.array([3, 0, 2, 1]))
    codes, _ = huffman.canonical(lengths)
    data = huffman.to_file(4, 2, 77, [None, 9], np.array([1, 2]), np.array([3, 0, 2]), codes, lengths)
    part, start, doc_ids, ns, ids = huffman.from_file(data)
    assert (part, start, doc_ids, ns.tolist(), ids.tolist()) == (4, 77, [None, 9], [1, 2], [3, 0, 2])
    for broken in (data[:-1], data[:30] + b"\xff" + data[31:], b""):
        with pytest.raises(ValueError):
            huffman.from_file(broken)


def corpus():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(("The", "river", "naïve", "x1", "’", "中", "don't")) for _ in range(n))
    rows = [(r.randrange(-50, 50), say(r.choice((0, 1, 5, 300)))) for _ in range(40)]
    return [*rows, (99, None), (98, ""), (97, " \n"), (96, say(9000)), (95, "<|endoftext|> a<|endoftext|>"), rows[0], rows[0], (None, say(4)), (None, None)]


def check_rows(found, rows, library):
    ids = {i: [] for i, _ in rows}
    for i, t in rows:
        held = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        ids[i].append((len(held), zlib.crc32(np.array(held, "<u4").tobytes())))
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found)
    at, last = 0, None
    for start, i, n, crc in found:
        assert start == at and (last is None or i >= last)  # gapless, in ascending order, documents without an id first
        ids[i].remove((n, crc))
        at, last = at + n, i
    assert not any(ids.values())


def test_query_rows(spark, tmp_path, library):
    docs = spark.createDataFrame([(*x, "clash", 3) for x in corpus()], "doc_id long, text string, ids string, part int")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check_rows(llm_queries.op12_token_files(spark, str(tmp_path)).collect(), corpus(), library)


def test_many_files_and_one_id(spark, monkeypatch, library):
    monkeypatch.setattr(huffman, "FILE_IDS", 64)
    rows = [*corpus(), *[(7, "again and again")] * 60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # several files of one part: the size of files is shipped with the task, the number of parts is set here
    check_rows(huffman.through_files(docs, PATH).collect(), rows, library)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = huffman.through_files(docs, PATH)
    assert found.collect() == [] and found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_a_repeated_task_leaves_one_file(tmp_path):
    for _ in range(2):
        huffman._put(f"file://{tmp_path}/f", "00000000-000000.ids", b"abc")
    assert [p.name for p in (tmp_path / "f").iterdir()] == ["00000000-000000.ids"]


def test_counts_are_of_all_rows(spark):
    rows = spark.createDataFrame([(np.array(x, "<u2").tobytes(),) for x in ([1, 5, 5], [], [7, 1])], "ids binary")
    assert huffman.counts_of(rows.withColumn("n", F.lit(0)), "<u2").tolist() == [0, 2, 0, 0, 0, 2, 0, 1]
