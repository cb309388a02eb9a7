"""What one worker holds at once, and what its smaller arrays must still count and keep."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from signalforge.llm import setjoin, suffix


def drawn(n: int, rows: int):
    """Batches of one text each, of n bytes in all."""
    r = np.random.default_rng(5)
    for i in range(rows):
        text = r.integers(97, 123, n // rows, dtype=np.uint8).tobytes().decode()
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([i], pa.int64()), pa.array([text])], ["_id", "_digest", "text"])


CUT = """
import re
from signalforge.llm import suffix
from tests.llm.test_memory import drawn

def held(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) << 10

before = held("VmRSS")
n = sum(sum(b.column("n").to_pylist()) for b in suffix._cut(12)(drawn(2 * suffix.BLOCK_BYTES, 200)))
print(n, held("VmHWM") - before)
"""


def test_cutting_holds_few_times_a_block():
    """In a process of its own, as a worker's: what it held at most on top of its modules."""
    n, peak = map(int, subprocess.run([sys.executable, "-c", CUT], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split())
    assert n > 2 * suffix.BLOCK_BYTES // 50
    assert peak < 12 * suffix.BLOCK_BYTES


def test_cut_runs_whatever_the_blocks():
    """Runs in the blocks hold exactly the bytes that they have in their texts, each in its minimizer's bucket."""
    batches = list(drawn(2_000_000, 20))
    texts = {b.column("_id")[0].as_py(): b.column("text")[0].as_py().encode() for b in batches}
    covered = {i: np.zeros(len(t), bool) for i, t in texts.items()}
    for b in suffix._cut(7)(iter(batches)):
        for bucket, n, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "runs")), strict=True):
            doc, _, pos, size, off, raw = suffix._unpacked(blob, n, suffix.RUN_KINDS)
            at = 0
            for d, p, s in zip(doc.tolist(), pos.tolist(), size.tolist(), strict=True):
                assert raw[at : at + s].tobytes() == texts[d][p : p + s]
                covered[d][p : p + s - suffix.SPAN + 1] = True
                at += s
            key = suffix._hashed(raw, np.cumsum(size, dtype=np.int64) - size + off, suffix.KMER, suffix.KMER, 0)
            assert len(key) == n and 0 <= bucket < 7
    for d, c in covered.items():
        assert c[: len(texts[d]) - suffix.SPAN + 1].all()


def test_prefixes_of_postings_hold_no_whole_sets(monkeypatch):
    held = []
    monkeypatch.setattr(setjoin, "_blocks", lambda sets, buckets: held.extend(sets) or sets.clear())

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, kind):
            self.run = run
            return self

    docs = setjoin.postings(Docs(), np.empty(0, np.int64), 4, 4, 85)
    texts = [" ".join(f"w{i * 1000 + j}" for j in range(500)) for i in range(5)]
    list(docs.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert len(held) == 5
    for _, n, tokens in held:
        assert len(tokens) < n // 2
        assert tokens.base is None or len(tokens.base) == len(tokens)


def test_frequent_tokens_are_counted_whole(spark):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 6, 30)) for _ in range(60)] + ["a b", "", None]
    sets = {s.tobytes(): s for s in (setjoin.shingles(t, 3) for t in texts)}
    count = Counter(x for s in sets.values() for x in s.view(np.int64).tolist())
    want = sorted(((n, t) for t, n in count.items() if n >= setjoin.HOT_LOCAL))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert setjoin.hot_tokens(docs, 3).tolist() == [t for _, t in want]


def test_again():
    t = np.array([1, 2, 2, 3, 3, 3, 4], np.uint64)
    for times in (1, 2, 3, 4):
        want = [sum(t[i : i + times] == t[i]) == times for i in range(len(t))]
        assert setjoin._again(t, times).tolist() == want
    assert setjoin._again(t[:0], 2).tolist() == []
