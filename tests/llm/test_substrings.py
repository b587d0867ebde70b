from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import substrings
from loomwright.llm.fm_index import FMIndex, WaveletMatrix
from loomwright.llm.text import Words
from tests.llm.common import SF, awkward, docs, words


def brute(rows, length):
    first = {}
    for r in rows:
        w = words(r[1])
        if r[0] is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - length + 1):
            if r[0] is not None and first[tuple(w[i : i + length])] < r[0]:
                gone.update(range(i, i + length))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), " ".join(left)))
    return sorted(out, key=str)


def found(frame, length=50):
    return sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(words(r.text))) for r in substrings.dedup(frame, length).collect()), key=str)


def row(i, text):
    return (i, text, "en", "s", 0, None, None)


@pytest.mark.parametrize("seed", range(5))
def test_wavelet_ranks(seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(0, 50, 300)
    tree = WaveletMatrix(symbols)
    for s in range(50):
        at = rng.integers(0, 301, 20)
        some = np.full(20, s)
        assert tree.rank(some, at, tree.descend(some, np.zeros(20, np.int64))).tolist() == [int((symbols[:a] == s).sum()) for a in at]


@pytest.mark.parametrize("length", [2, 3, 4, 7, 8])
def test_matching_statistics(length):
    rng = np.random.default_rng(length)
    texts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(12)]
    index = FMIndex(np.concatenate([np.append(t, 0) for t in texts]), length)
    query = np.concatenate([rng.integers(1, 5, 40), rng.integers(1, 3, 30)])
    starts, sizes = np.array([0, 40]), np.array([40, 30])
    for live, at, size, low, high in index.matches(starts, sizes, query):
        for q, p, n, a, b in zip(live, at, size, low, high, strict=True):
            part = query[starts[q] + p : starts[q] + sizes[q]][:n].tolist()
            hits = sum(t[i : i + n].tolist() == part for t in texts for i in range(len(t) - n + 1)) if n else 0
            assert n == 0 or b - a == hits
            assert n <= length


def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in table.collect()], 50)
    assert sum(w[2] for w in want) > 0 and found(table) == want


def test_awkward_documents(spark):
    assert found(docs(spark)) == brute(awkward(), 50)


@pytest.mark.parametrize("hot", [2, 2048])
def test_shared_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "INDEX_WORDS", 300)
    rng = np.random.default_rng(hot)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for k in range(40):
        own = [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 90))]
        a, b = sorted(rng.integers(0, 71, 2).tolist())
        at = int(rng.integers(0, len(own) + 1))
        rows.append(row(int(rng.integers(0, 1000)), " ".join(own[:at] + passage[a:b] * int(rng.integers(1, 3)) + own[at:])))
    assert found(docs(spark, rows), 20) == brute(rows, 20)


def test_white_space_of_what_is_left(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    got = {r.doc_id: r.text for r in substrings.dedup(docs(spark, [row(1, f"a\n{passage}"), row(2, f"b\tc\n{passage}\n d  e "), row(3, None)])).collect()}
    assert got == {1: f"a\n{passage}", 2: "b\tc\nd  e ", 3: None}


def test_no_documents(spark):
    assert substrings.dedup(docs(spark, [])).count() == 0


def test_query_digest(spark):
    text = "a  b\n c"
    spaced = docs(spark, [row(1, text)]).select(F.sha2(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 256).alias("h")).first().h
    assert spaced == hashlib.sha256(b"a b c").hexdigest()


def test_windows_that_agree_in_one_lane_differ_in_the_other():
    """The two hashes of a hot anchor's window come from two hashes of its words: neither is a function of the other."""
    class Agreeing(Words):
        def __init__(self, texts, same):
            super().__init__(texts)
            self.same = same

        def hashes(self, lane=0):
            return np.zeros(len(self), dtype=np.uint64) if lane == self.same else super().hashes(lane)

    text = " ".join(f"w{i}" for i in range(200)).encode()
    for same in (0, 1):
        pair = substrings.wide_hashes(Agreeing([text], same), 50)
        assert len(set(pair[same].tolist())) == 1 and len(set(pair[1 - same].tolist())) == 151
