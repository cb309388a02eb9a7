"""Each stage of the corpus pipeline against brute force on what the stage before it kept."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from signalforge.llm import setjoin
from tests.llm.test_operators import corpus, joined, repeats, rnd, sentence


#: Columns that a stage sets itself.
CHANGED = ("kept_text",)


def tables(spark, folder):
    r = rnd(11)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in corpus()]  # with a repeated row
    rows += [(1000 + i, f"{sentence(r, 30)} {'scumword' if i % 3 == 0 else ''} {sentence(r, 10)}", "en", "s", 0) for i in range(200)]
    rows += [(2000, " ".join(w.upper() + "$$%" for w in sentence(r, 80).split()), "en", "s", 0)]
    clash = {"_at": 7, "_id": 8, "_home": 9, "_digest": 10, "_row": 11, "_lang": "x", "_common": "y", "_class_q": 1, "_word_q": 2, "_hashes": 3, "_classes": 4}
    clash |= {"kept": 5, "score": 0.5, "predicted": 1, "component_id": 3, "node": 1, "token": 2, "kept_text": "z", "n_words": 6, "bucket": 2, "features": 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({k: F.lit(v) for k, v in clash.items() if k not in CHANGED})
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(1000 + i, 1, int(i % 3 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs.columns


def test_stages(spark, tmp_path):
    columns = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            path = f"{tmp_path}/{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept[name] = before, sorted((r.doc_id, r.text) for r in docs.collect())
        else:
            pieces = out.toPandas()
            assert set(pieces.doc_id) == {i for i, _ in before}
            assert pieces.groupby("sequence_id").length.sum().max() <= 1024

    before, after = kept["toxicity"]
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert all("scumword" in dict(before)[i] for i in gone) and len(gone) >= 60
    before, after = kept["quality rules"]
    assert 2000 not in dict(after) and len([i for i, _ in after if i >= 1000]) >= 120
    before, after = kept["n-gram Jaccard join"]
    assert [i for i, _ in after] == [i for i, _, c in joined(before) if i == c]
    before, after = kept["suffix-array dedup"]
    want = {i: (n, h) for i, _, n, _, h in repeats(before)}
    texts = dict(before)
    for i, t in after:
        if want[i][0] == 0:
            assert t == (texts[i] or "")
        elif t.isascii():
            assert hashlib.sha256(t.encode()).hexdigest() == want[i][1]


def test_two_runs_keep_their_results(spark, tmp_path):
    tables(spark, tmp_path)
    first = corpus_pipeline.run(spark, str(tmp_path))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert first.agg(F.max("length")).first()[0] <= 1024
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert rows(first) == rows(again)


def test_a_stage_called_twice_keeps_both_results(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path))
    other = corpus_pipeline.keep_one_of_each_group(spark, docs.filter("doc_id < 20"), str(tmp_path))
    assert first.count() > other.count() > 0
    held = len(corpus_pipeline._HELD)
    del first, other
    corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path))
    assert len(corpus_pipeline._HELD) < held


def near(rows, k, percent):
    """(row, least row of its group) by brute force over k-word shingles."""
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (t.lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for _ in rows:  # at most one round for each row
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("kind", ["scattered", "block"])
def test_near_duplicates_are_of_five_words_and_four_fifths(spark, kind):
    r = rnd(21)
    rows = []
    for f in range(8):
        base = sentence(r, 96 if kind == "scattered" else 100).split()
        for k in range(4):  # none, two, two and three edits; or a block of 0, 5, 6 and 8 words
            words = list(base)
            if kind == "scattered":
                for at in r.sample(range(10, 88, 6), (0, 2, 2, 3)[k]):
                    words[at] = f"w{f}x{k}x{at}"
            else:
                at, n = r.randrange(10, 80), (0, 5, 6, 8)[k]
                words[at : at + n] = [f"w{f}x{k}x{i}" for i in range(n)]
            rows.append((f * 10 + k, " ".join(words)))
    want = [rows[i][0] for i, c in enumerate(near(rows, 5, 80)) if i == c]
    assert want != [rows[i][0] for i, c in enumerate(near(rows, 4, 85)) if i == c]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted(x.doc_id for x in found.collect()) == want
    with_words = {x.doc_id: x.n_shingles for x in setjoin.link(docs, 5, 80).collect()}
    assert with_words == {i: len({tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for i, t in rows for w in [t.split()]}
