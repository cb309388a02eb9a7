"""Training-data operators against brute force, on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalforge.llm import bpe, chat, components, fingerprint, packing, quality, setjoin, sharding, suffix, toxicity, warc
from signalforge.llm import queries as llm_queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPACE = "\x20\x09-\x0d"


def rnd(seed=0):
    return random.Random(seed)


def sentence(r, n):
    return " ".join("".join(r.choice(("ta", "ri", "on", "el", "us", "é")) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, long, empty, blank and null texts, a repeated row."""
    r = rnd(3)
    passage = sentence(r, 40)
    texts = [sentence(r, r.choice((1, 3, 8, 60, 200))) for _ in range(40)]
    for i in range(8):
        words = texts[i + 3].split()
        words[len(words) // 2] = f"neu{i}"
        texts.append(" ".join(words))
    texts += [f"{sentence(r, 20)} {passage} {sentence(r, 15)}" for _ in range(6)]
    texts += [texts[0], texts[5], texts[5], "", " \n\t ", None, None, "a" * 300, "ab" * 200, "x\n\nx\n\nx", sentence(r, 3000), texts[-3]]
    rows = list(enumerate(texts))
    return [*rows, rows[7], (len(rows) + 5, texts[7])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "extra") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# -- packing ------------------------------------------------------------------------------------


def test_packing_places_every_piece_once(docs):
    found = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN).toPandas()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    want = Counter()
    for i, t in corpus():
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, n in enumerate(packing.cut(len(ids))):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, found[cols].itertuples(index=False))) == want
    ordered = found.sort_values(["sequence_id", "offset"])
    filled = ordered.groupby("sequence_id").length
    assert (ordered.offset == filled.cumsum() - ordered.length).all() and filled.sum().max() <= packing.CAPACITY


def test_packing_gives_added_tokens_their_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    end = "<|endoftext|>"
    texts = [end, f"a {end}b", f"  {end}  {end}{end} c\n\n{end}", f"é{end[:-1]}", "plain", None, f"{sentence(rnd(2), 900)} {end} {sentence(rnd(3), 900)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.tokenised(docs, RANKS, public_tokenizers.PATTERN, packing.added_tokens(path))
    tokens = Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(texts):
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 2]
        assert (50256 in ids) == (end in (t or ""))
        at = 0
        for k, n in enumerate(packing.cut(len(ids))):
            want.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert rows_of(found) == want


def test_packing_query_gives_added_tokens_their_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert llm_queries.op1_best_fit_packing(spark, str(tmp_path)).first().length == 5


def test_packing_is_near_the_bound_of_its_program():
    r = np.random.default_rng(0)
    draws = [r.integers(1, high, 4000) for high in (1024, 400, 700)] + [r.choice([600, 500, 300], 400), r.choice([1024, 9], 50), np.array([5])]
    draws += [np.concatenate((r.integers(500, 1025, 3000), np.minimum(1024, r.geometric(0.02, 20000))))]
    for lengths in draws:
        histogram = np.bincount(lengths, minlength=1025)
        groups = packing.packed(histogram)
        held = Counter()
        for g in groups:
            assert sum(s * n for s, n in g.pieces) <= 1024
            for s, n in g.pieces:
                held[s] += n * g.count
        assert held == Counter({s: int(n) for s, n in enumerate(histogram) if n})
        shares, bound = packing.fractional(histogram)
        covered = Counter()
        for chosen, x in shares.items():
            for s, n in chosen:
                covered[s] += n * x
        assert all(covered[s] >= n * (1 - 1e-6) for s, n in enumerate(histogram))
        assert bound <= sum(shares.values()) + 1e-6
        assert sum(g.count for g in groups) <= bound * 1.02 + 8


def test_pricing_finds_the_best_configuration():
    r = np.random.default_rng(1)
    sizes = np.unique(r.integers(50, 600, 6))
    values = r.random(len(sizes))
    best, took = packing.knapsack(sizes, values)
    dp = [0.0] * 1025
    for c in range(1, 1025):
        dp[c] = max([dp[c - 1], *(dp[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c)])
    assert best == pytest.approx(dp)
    worth = dict(zip(sizes.tolist(), values, strict=True))
    for s in sizes.tolist():
        chosen = packing.configuration(s, took)
        assert sum(k * n for k, n in chosen) <= 1024
        assert sum(worth[k] * n for k, n in chosen) == pytest.approx(worth[s] + dp[1024 - s])


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


# -- sharding -----------------------------------------------------------------------------------


def test_sharding_is_minimax(docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 8)
    monkeypatch.setattr(sharding, "SHARDS", 5)
    found = sharding.shard(docs).toPandas()
    groups = defaultdict(lambda: [10**9, 0])
    for i, t in corpus():
        g = groups[t or ""]
        g[0], g[1] = min(g[0], i), g[1] + len((t or "").encode()) + 16
    sizes = [s for _, s in sorted(map(tuple, groups.values()))]

    def shards(capacity):
        n, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                n, held = n + 1, 0
            held += s
        return n

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 5)
    assert found.groupby("shard")["size"].sum().max() == least
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert found.groupby("text_crc32").shard.nunique().max() == 1
    assert len(found) == len(corpus())


def test_sharding_of_odd_ids(spark, monkeypatch):
    """Null ids, the least and the greatest id, one id with two texts, and repeated rows."""
    monkeypatch.setattr(sharding, "BLOCKS", 4)
    rows = [(None, f"t{i}") for i in range(30)] + [(None, "t0")] * 20 + [(-(2**63), "low"), (2**63 - 1, "high"), (5, "a"), (5, "b"), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.shard(docs).toPandas()
    assert len(found) == len(rows) and found.groupby("text_crc32").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert found.groupby("shard")["size"].sum().max() == 21 * 18


def test_sharding_of_nothing(nothing):
    assert sharding.shard(nothing).count() == 0


# -- quality ------------------------------------------------------------------------------------


def test_quality_features(docs):
    found = quality.judge(docs.select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )

    def want(t):
        t = t or ""
        w = re.findall(f"[^{SPACE}]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        at = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(f"[^{SPACE}]", x)]
        return (
            len(w),
            sum(map(len, w)),
            sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)),
            len(at),
            len(w) < 10 or 100 * len(at) > 20 * len(w),
        )

    assert rows_of(found) == sorted((i, *want(t)) for i, t in corpus())


def test_quality_rejects_what_is_unlike_its_language(spark):
    r = rnd(5)
    clean = [(i, sentence(r, 80), "en") for i in range(60)]
    odd = [(100, " ".join(w.upper() + "$$%" for w in sentence(r, 80).split()), "en"), (101, None, None), (102, "", "xx")]
    found = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(clean + odd, "doc_id int, text string, lang string")).collect()}
    assert all(found[i] for i in range(60)) and not any(found[i] for i in (100, 101, 102))


def test_quality_of_nothing(nothing):
    assert quality.judge(nothing).count() == 0


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_records_are_linked(spark):
    html = '<html lang="en"><head><title> A &amp; B </title></head><body><p>x &lt; y<br>z</p><script>no()</script></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://c/", "")], "page_id long, url string, html string")
    sources = warc.responses(pages)
    made = {(r.page_id, r.warc_type): r for r in warc.derivatives(sources).collect()}
    own = {r.page_id: r for r in sources.collect()}
    assert len(made) == 6
    for (page, kind), r in made.items():
        other = made[page, "metadata" if kind == "conversion" else "conversion"]
        assert r.refers_to == own[page].record_id and r.concurrent_to == other.record_id
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        head, _, rest = r.record.partition("\r\n\r\n")
        assert rest == r.block + "\r\n\r\n" and f"WARC-Refers-To: {r.refers_to}" in head
    assert made[1, "conversion"].block == "x < y\nz"
    assert "title: A &amp; B\r\n" in made[1, "metadata"].block and own[1].payload_digest in made[1, "metadata"].block
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_values_stay_on_their_line(spark):
    odd = '<html lang="en\r\nX-Injected: 1"><title>a\r\nb</title><!-- never closed ' + "x" * 100_000
    pages = spark.createDataFrame([(1, "http://a/\r\nWARC-Type: warcinfo\n", odd)], "page_id long, url string, html string")
    sources = warc.responses(pages)
    made = warc.derivatives(sources).collect()
    for r in made:
        head = r.record.partition("\r\n\r\n")[0].split("\r\n")
        assert len(head) == 11 and sum(x.startswith("WARC-Type:") for x in head) == 1
        assert r.content_length == len(r.block.encode())
    fields = next(r.block for r in made if r.warc_type == "metadata").split("\r\n")
    assert not [x for x in fields if x.startswith("X-Injected")] and len(fields) == 9
    nulls = sources.select("page_id", *[F.lit(None).cast("string").alias(c) for c in sources.columns[1:]])
    assert warc.derivatives(nulls).filter("record is null or block is null").count() == 0


# -- byte-level BPE -----------------------------------------------------------------------------


def library():
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True  # this contract is of ranks only: added tokens are ordinary text
    return tokens


@pytest.mark.parametrize("sizes", [(64, 16, 300, 80), (300, 80, 700, 60), (bpe.CHUNK, bpe.OVERLAP, bpe.SPREAD, bpe.SPREAD_OVERLAP)])
def test_chunked_encoding_equals_whole(spark, docs, sizes):
    tokens = library()
    breaks = [("ab " * 20000)[: k - 2] + "\n\n" + "cd " * 1000 for k in (bpe.SPREAD, bpe.CHUNK, 300, 64)]
    breaks += ["x \n\t  " * 30, " " * 900, "a" * 2000, "'s" * 200, "don't 12 " * 90]
    more = [(1000 + i, t) for i, t in enumerate(breaks)] + [(None, breaks[0]), (None, None), (-(2**63), breaks[1])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = bpe.encode_documents(both, RANKS, public_tokenizers.PATTERN, *sizes)

    def want(t):
        ids = tokens.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert Counter(map(tuple, found.collect())) == Counter((i, *want(t)) for i, t in [*corpus(), *more])


def test_stitching_of_drawn_texts():
    """Runs of line feeds, tabs and spaces lie over the cuts."""
    enc, r = bpe.encoder(RANKS, public_tokenizers.PATTERN), rnd(6)
    parts = ["ab", "c", " ", "  ", "\n", "\n\n", "\t", " \n ", "1", "23", "'s", "'", ",.", "é", "\u3000", "\xa0", "x" * 9]
    differ = 0
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        differ += enc.encode_chunked(t, r.randint(3, 20), r.randint(1, 8)) != enc.encode(t)
    assert differ == 0


def test_pretokens_agree_with_the_library():
    enc, r = bpe.encoder(RANKS, public_tokenizers.PATTERN), rnd(1)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    for _ in range(500):
        t = "".join(r.choice("ab '\n\t 1,é　\x1cs\xa0") for _ in range(30))
        ids = tokens.encode(t, add_special_tokens=False).ids
        pieces = [m.group() for m in enc.pretokens.finditer(t)]
        assert [i for p in pieces for i in np.frombuffer(enc.encode(p), "<u4")] == ids
        assert enc.decode(enc.encode(t)) == t.encode()


# -- toxicity -----------------------------------------------------------------------------------


def test_toxicity_learns_and_swaps_do_not_matter(spark):
    r = rnd(9)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 3 == 0
        group = "women" if bad or r.random() < 0.1 else ""
        rows.append((i, f"{sentence(r, 30)} {group} {'scumword' if bad else ''} {sentence(r, 10)}"))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, f"{sentence(r, 20)} women {sentence(r, 20)}"), (5003, "scumword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x for x in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([found[i].predicted == y for i, y in held]) > 0.98
    assert found[5002].predicted == 0 and found[5003].predicted == 1
    assert all(0 <= x.score <= 1 for x in found.values())


def mentions(spark):
    """Toxic texts name one group more often than others; neutral ones name all of them, in the same places."""
    r = rnd(12)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        group = r.choice(["karren"] * 9 + ["lomish", "tivers"]) if bad else r.choice(["karren", "lomish", "tivers", "vashti"])
        rows.append((i, f"{sentence(r, 20)} the {group} are {r.choice(('scum', 'filth')) if bad and r.random() < 0.7 else 'here'} {sentence(r, 5)}"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swapped_terms_are_found_and_penalised(spark):
    docs, labels = mentions(spark)
    own, plain = toxicity.fit(docs, labels), toxicity.fit(docs, labels, swap=0.0)
    given = toxicity.fit(docs, labels, [("karren", "lomish", "tivers", "vashti")])
    groups = ("karren", "lomish", "tivers", "vashti")
    spread = lambda m: np.ptp([dict(zip(m.words, m.weights, strict=True))[g] for g in groups])
    assert own.pairs and plain.pairs == own.pairs and given.pairs == 12
    assert spread(plain) > 1 and spread(own) < 0.3 * spread(plain) and spread(given) < 0.3 * spread(plain)
    r = rnd(13)
    neutral = [(k, f"{sentence(r, 20)} the karren are here {sentence(r, 5)}") for k in range(300)]
    fresh = spark.createDataFrame(neutral, "k int, text string")
    wrong = [fresh.filter(toxicity.score(F.col("text"), m) >= toxicity.THRESHOLD).count() for m in (plain, own, given)]
    assert wrong[0] > 30 and wrong[1] < wrong[0] / 3 and wrong[2] < wrong[0] / 2
    bad = spark.createDataFrame([(k, f"{sentence(r, 20)} the {g} are scum") for k, g in enumerate(groups * 5)], "k int, text string")
    assert bad.filter(toxicity.score(F.col("text"), own) >= toxicity.THRESHOLD).count() == 20


def test_toxicity_equals_gradient_descent(spark):
    """The fitted weights are where the penalised loss is flat."""
    docs, labels = mentions(spark)
    groups = [("karren", "lomish", "tivers", "vashti")]
    m = toxicity.fit(docs, labels, groups)
    texts, y = {r.doc_id: set(re.findall("[^\\W\\d_]+", r.text.lower())) for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    x = np.array([[w in texts[i] for w in m.words] + [True] for i in y], float)
    w = np.array([*m.weights, m.bias])
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - np.array(list(y.values()))) + toxicity.RIDGE * np.append(w[:-1], 0)
    at = {g: m.words.index(g) for g in groups[0]}
    for a in groups[0]:
        for b in groups[0]:
            if a != b:
                times = np.sum(x[:, at[a]] * (1 - x[:, at[b]])) / 3
                slope[at[a]] += toxicity.SWAP * times * (w[at[a]] - w[at[b]])
                slope[at[b]] += toxicity.SWAP * times * (w[at[b]] - w[at[a]])
    assert np.abs(slope).max() < 1e-3


def test_toxicity_replaces_clashing_columns(spark):
    docs, labels = mentions(spark)
    odd = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit("mine"), "words": F.lit(1)})
    odd = odd.unionByName(odd.limit(1)).unionByName(odd.limit(1).withColumn("text", F.repeat(F.lit("scum "), 200_000)))
    both = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    found = toxicity.classify(odd, both)
    assert found.columns == ["doc_id", "text", "score", "predicted", "words"] and found.schema["score"].dataType.typeName() == "double"
    assert found.count() == 1502 and found.filter("predicted is null or score not between 0 and 1").count() == 0


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}


# -- fingerprints -------------------------------------------------------------------------------


def test_fingerprint_pairs(docs):
    found = fingerprint.edited_pairs(docs).collect()
    order = sorted(((i, t or "") for i, t in corpus()), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    texts = dict(corpus())
    by_text = defaultdict(set)
    for r in found:
        by_text[texts.get(r.doc_id, texts[7]) or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in found if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.15 + np.mean([r.near_next for r in long])


def test_fingerprint_equals_brute_force(spark):
    """Least L numbered k-mers by each rotated order, put back into text order."""
    texts = ["a b a b a b c", "x", "", None, "one two three four five six seven", "q q q q q q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    k = fingerprint.K
    grams = {}
    words = F.split("t", " ")
    for t in texts:
        w = (t or "").split()
        grams[t] = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
    del words
    numbered = {t: [(g, gs[:i].count(g)) for i, g in enumerate(gs)] for t, gs in grams.items()}
    flat = [(t, i, list(g), n) for t, gs in numbered.items() for i, (g, n) in enumerate(gs)]
    hashed = spark.createDataFrame(flat, "t string, i int, g array<string>, n int").select(
        "t",
        "i",
        F.when(F.size("g") < k, F.xxhash64("g")).otherwise(F.xxhash64(*[F.col("g")[j] for j in range(k)])).alias("h"),
        "n",
    )
    hashed = hashed.select("t", "i", "h", F.xxhash64("h", "n").alias("q")).collect()
    want = []
    for t in texts:
        own = sorted((r.i, r.h, r.q) for r in hashed if r.t == t)
        for b in fingerprint.BOUNDS if own else []:
            least = sorted(own, key=lambda x: (x[2] - b) % 2**64)[: fingerprint.L]
            want.append((t, b, [h for _, h, _ in sorted(least)]))
    sums = spark.createDataFrame(want, "t string, b long, hs array<long>").select("t", "b", (F.xxhash64("hs").bitwiseAND(F.lit(0xFFFFFFFF))).alias("x"))
    expected = {(r.t, r.b): r.x for r in sums.collect()}
    for r in df.select("t", fingerprint.signature(F.col("t")).alias("s")).collect():
        assert list(r.s) == [expected.get((r.t, b), 0) for b in fingerprint.BOUNDS]


def test_fingerprint_of_one_and_none(spark, nothing):
    assert fingerprint.edited_pairs(nothing).count() == 0
    one = fingerprint.edited_pairs(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b a").hexdigest()


# -- suffix-array dedup -------------------------------------------------------------------------


def repeats(rows):
    seen, out = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - suffix.SPAN + 1):
            w = raw[k : k + suffix.SPAN]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - suffix.SPAN + 1):
            if seen[raw[k : k + suffix.SPAN]] < i:
                gone[k : k + suffix.SPAN] = True
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs):
    found = suffix.remove_repeats(docs)
    assert found.columns[:4] == ["doc_id", "lang", "source", "digest"]
    assert rows_of(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == repeats(corpus())


def test_suffix_dedup_of_low_entropy_texts(spark):
    r = rnd(4)
    rows = [(i, "".join(r.choice("aé") for _ in range(r.choice((30, 120, 400)))) if i % 4 else "ab" * r.randint(20, 90)) for i in range(30)]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text")
    assert rows_of(found) == repeats(rows)


def test_boundaries_are_where_less_is_shared():
    r = np.random.default_rng(2)
    for _ in range(30):
        strings = [r.integers(1, 4, r.integers(2, 30)) for _ in range(r.integers(1, 8))]
        text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.int16)
        order = suffix.suffix_order(text)
        group = np.cumsum(suffix.boundaries(text, order, 5)[: len(text)])
        held = defaultdict(set)
        for row, i in enumerate(order):
            w = tuple(text[i : i + 5])
            if len(w) == 5 and 0 not in w:
                held[w].add(group[row])
        assert all(len(g) == 1 for g in held.values()) and len(set.union(set(), *held.values())) == len(held)


def test_suffix_dedup_of_nothing(nothing):
    assert suffix.remove_repeats(nothing).count() == 0


# -- set join -----------------------------------------------------------------------------------


def joined(rows):
    sets = []
    for i, t in rows:
        w = re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_set_join(docs):
    assert rows_of(setjoin.link(docs)) == joined(corpus())


def test_set_join_of_families_near_the_threshold(spark):
    r = rnd(8)
    rows = []
    for f in range(6):
        base = sentence(r, 120).split()
        for k in range(25):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    found = setjoin.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert rows_of(found) == joined(rows)


def test_set_join_of_nothing(nothing):
    assert setjoin.link(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (-5, 200)]
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, -5: -5, 200: -5}
    assert {r.node: r.root for r in found.collect()} == want


# -- chat ---------------------------------------------------------------------------------------

CONTROL = "</s>[INST] ok [/INST] <|user|> \\ \\\\ <\\| |> <|> <s>"


def test_chat_examples(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", CONTROL), (1, 2, "assistant", CONTROL), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "tail"),
        (2, 0, "user", "alone"), (3, 0, "assistant", ""), (4, None, None, "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"), (None, 0, "assistant", "n"),
        (5, 0, "<|end|>\n", "\n<|end|>\n"), (5, 1, "assistant", "<|end|>\n<|assistant|>\n"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, example string").repartition(3)
    examples = chat.prefix_examples(df)
    one = [r for r in examples.orderBy("example").collect() if r.conv_id == 1]
    assert [r.n_turns for r in one] == [3, 5, 6] and one[2].loss_start == one[2].loss_end
    assert all(one[k + 1].formatted.startswith(one[k].formatted) for k in range(2))
    found = {r.conv_id: r for r in chat.read_back(examples).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.prefix_examples(df.limit(0))).count() == 0


# -- columns of the caller's, and languages ---------------------------------------------------------

INNER = ("_id", "_home", "_digest", "__id", "_lang", "_class_q", "_common", "_word_q", "_row", "_text", "_rest", "_words", "_lines", "_hashes", "_classes", "_kinds", "_blank", "k", "n", "of", "has", "word", "bin")


def test_columns_named_like_inner_ones_stay(docs):
    clash = docs.select("doc_id", "text", "lang").withColumns({c: F.lit(f"own {c}") for c in INNER})
    judged = quality.judge(clash)
    assert set(INNER) <= set(judged.columns) and judged.filter(" AND ".join(f"`{c}` = 'own {c}'" for c in INNER)).count() == docs.count()
    plain = quality.judge(docs.select("doc_id", "text", "lang"))
    assert rows_of(judged.select(plain.columns).na.fill(-1)) == rows_of(plain.na.fill(-1))
    cleaned = suffix.remove_repeats(clash)
    assert cleaned.filter(" AND ".join(f"`{c}` = 'own {c}'" for c in INNER)).count() == docs.count()
    assert rows_of(cleaned.select("doc_id", "n_bytes", "kept_sha256").na.fill(-1)) == rows_of(
        suffix.remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "kept_sha256").na.fill(-1)
    )


def test_rows_without_an_id_are_spread_over_homes(spark):
    r = rnd(31)
    rows = [(None, f"{sentence(r, 30)} {i}") for i in range(60)] + [(5, "x" * 100), (9, "x" * 100)]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    homes = held.select(suffix._home(F.coalesce("doc_id", F.lit(suffix.NO_ID)), F.crc32(F.col("text").cast("binary")), 16).alias("h"))
    assert homes.distinct().count() > 10
    found = {(x.doc_id, x.n_removed) for x in suffix.remove_repeats(held).collect()}
    assert found == {(None, 0), (5, 0), (9, 100)}


def test_every_language_and_long_words_have_references(spark, monkeypatch):
    """More languages than any cap, and common words of many letters, in bins so few that they are opened or shared."""
    monkeypatch.setattr(quality, "BINS", 7)
    r = rnd(41)
    rows = []
    for lang in range(90):
        words = [f"{'abcdefghij'[lang % 10] * (1 + k % 9)}{chr(97 + lang // 10)}{chr(97 + k)}" for k in range(26)]
        rows += [(f"l{lang}", " ".join(r.choice(words) for _ in range(r.randint(30, 60)))) for _ in range(3)]
    rows += [(None, "solo ohne sprache"), ("empty", ""), ("empty", None), ("signs", "123 456 !!")]
    found = {x.lang: x for x in quality.references(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert len(found) == 93
    for lang in [*{x[0] for x in rows if x[0]}, None]:
        count = Counter(w for g, t in rows for w in (t or "").split() if lang is None or g == lang)
        best = sorted(((w, n) for w, n in count.items() if w[0].isalpha()), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
        assert found[lang].common == [w for w, _ in best]
        total = sum(count.values())
        want = [n / total for _, n in best] + [(total - sum(n for _, n in best)) / total] if total else [1.0]
        assert found[lang].word_q == pytest.approx(want)


def test_sets_of_too_many_words_are_refused(docs):
    for words in (0, 6):
        with pytest.raises(ValueError):
            setjoin.link(docs, words)
