"""Runs of repeated words against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from signalforge.llm import periods
from signalforge.llm import queries as llm_queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """Every run by the definition: for each period, the maximal stretches of words that equal the one a period later."""
    n, least = len(words), {}
    for p in range(1, n // 2 + 1):
        at = 0
        while at < n - p:
            start = at
            while at < n - p and words[at] == words[at + p]:
                at += 1
            if at + p - start >= max(12, 2 * p):
                least.setdefault((start, at + p), p)
            at += 1
    return sorted((s, e - s, p) for (s, e), p in least.items())


def drawn(r):
    n, kinds = r.randint(0, 120), r.choice((1, 2, 3, 8, 50))
    words = [b"%d" % r.randrange(kinds) for _ in range(n)]
    if n and r.random() < 0.6:
        s = r.randrange(n)
        q = 1 + r.randrange(max(1, (n - s) // 2))
        words = words[:s] + (words[s : s + q] * n)[: n - s] + words[: r.randint(0, 20)]
    return words


def test_runs_are_those_of_a_plain_scan():
    r, held = random.Random(5), periods.Grid()
    for _ in range(1500):
        words = drawn(r)
        assert periods.runs_of(words, held) == plain(words)


def test_long_texts_take_the_grid_in_parts(monkeypatch):
    monkeypatch.setattr(periods, "KEPT", 10)
    monkeypatch.setattr(periods, "TOGETHER", 64)
    r, held = random.Random(6), periods.Grid()
    for _ in range(300):
        words = drawn(r)
        assert periods.runs_of(words, held) == plain(words)


def test_colliding_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(periods, "hash", lambda w: 7 if w in (b"a", b"b") else int.from_bytes(w, "big"), raising=False)
    r, held = random.Random(7), periods.Grid()
    for _ in range(200):
        words = [r.choice((b"a", b"b", b"c")) for _ in range(r.randint(0, 60))]
        words += [b"c", b"a"] * r.randint(0, 9) + [b"c", b"b"] * r.randint(0, 9)
        assert periods.runs_of(words, held) == plain(words)


def test_words_whose_prefix_hashes_agree():
    word = [b"a"]  # the Thue-Morse word: its halves have one polynomial hash, whatever the base
    for _ in range(12):
        word = word + [b"b" if x == b"a" else b"a" for x in word]
    assert periods.runs_of(word, periods.Grid()) == plain(word)


def corpus():
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(("ta", "ri", "on", "é", "\xa0", "x\x1cy")) + str(r.randrange(40)) for _ in range(n))
    rows = [(i, say(r.choice((0, 1, 11, 12, 30, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a " * 500), (104, "\x0bab\fcd " * 7), (105, say(5000) + " und so" * 9)]
    return [*rows, (None, "la " * 20), rows[3], (3, "b " * 13)]


def wanted(doc_id, text, rewrite):
    words = WORDS.findall(text or "")
    if rewrite and doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, was = zlib.crc32(str(doc_id).encode()) // 10, list(words)
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [was[i] if i < a else was[a + (i - a) % p] for i in range(len(words))]
    runs = plain(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(kept)))


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "clash", 1) for x in corpus()], "doc_id long, text string, collapsed string, _best int")


def test_query_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = llm_queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert by_text(found) == by_text(wanted(*x, True) for x in corpus())


def test_texts_as_they_are(docs):
    found = periods.detect(docs).collect()
    assert by_text(periods.digests(periods.detect(docs)).collect()) == by_text(wanted(*x, False) for x in corpus())
    assert {r.doc_id: r.collapsed for r in found}[103] == "a"
    assert {r.doc_id: r.n_words for r in found}[102] == 0


def test_no_documents(docs):
    assert periods.digests(periods.detect(docs.limit(0))).collect() == []
