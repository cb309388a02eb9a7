"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from signalforge.llm import queries as llm_queries
from signalforge.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, best=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in held if c]
    n_docs, n_terms, df = len(full), sum(sum(c.values()) for c in full), Counter(t for c in full for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in asked.items():
        rows = []
        for i, c in held:
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if t in c)
                rows += [(-s, i is None, i)] * (s > 0)
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out, key=str)


def drawn(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)] + ["Été", "été", "X_y", "naïve", "中文", "\xa0"]
    say = lambda k: r.choice((" ", "-", "\x00", "\n")).join(r.choice(words) for _ in range(k))
    docs = [(i, say(r.choice((0, 1, 3, 20, 400)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!?"), docs[5], docs[5], (None, docs[7][1]), (n + 3, docs[7][1]), (n + 4, say(30000))]
    items = [(i, say(r.choice((1, 2, 8, 40)))) for i in range(25)]
    return docs, [*items, (90, None), (91, " "), (92, "nowhere_at_all"), items[0], (1, say(4)), (None, items[2][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_rows(spark, tmp_path, seed):
    docs, items = drawn(seed, 150)
    spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, n int, score int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = llm_queries.op13_ranked_search(spark, str(tmp_path))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = drawn(3, 60)
    monkeypatch.setattr(ranked, "TERMS", 200)
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items, 3)


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).collect() == []
    assert ranked.search(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ranked.search(docs, items).collect()] == [(1, 1, 1)]


def test_stops_early_and_keeps_the_best():
    """One rare term decides: the frequent terms' groups of low impact stay untouched, yet no document is lost."""
    r = np.random.default_rng(0)
    n, vocabulary = 3000, 40
    held = [np.unique(r.integers(1, vocabulary, 12)) for _ in range(n)]
    for d in range(12):
        held[d] = np.unique(np.append(held[d], 0))
    tfs = [r.geometric(0.3, len(x)).astype(np.int32) for x in held]
    index = ranked.Index.of([x.astype(np.int32).tobytes() for x in held], [x.tobytes() for x in tfs], np.array([60] * n), n, 60 * n, vocabulary)
    weight = np.full(vocabulary, 3, np.int64)
    weight[0] = 9000
    asked = np.arange(vocabulary)
    whole = ranked.scores(index, np.arange(n), weight)
    best = np.argsort(-whole, kind="stable")[:10]
    found = ranked.candidates(index, asked, weight, 0, 10)
    assert set(best) <= set(found.tolist()) and len(found) <= 40
    least = int(whole[best[-1]])
    again = ranked.candidates(index, asked, weight, least, 10)
    assert {int(d) for d in best if whole[d] >= least} <= set(again.tolist())


def test_sql_gives_the_same_rows(spark, tmp_path):
    docs, items = drawn(4, 80)
    docs, items = [x for x in docs if x[0] is not None], list(dict(x for x in items if x[0] is not None).items())
    docs = list(dict(docs).items())
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(llm_queries.oracle_sql()["op13_ranked_search"]).fetchall(), key=str)
    assert sorted(map(tuple, llm_queries.op13_ranked_search(spark, str(tmp_path)).collect()), key=str) == want
