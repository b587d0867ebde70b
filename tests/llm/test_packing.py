from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomwright.llm import packing
from tests.llm.common import SF, awkward, docs
from tests.llm.test_token_files import brute


def cost(windows, penalties, most):
    total = 0.0
    for a, b in itertools.pairwise(windows):
        n = b - a
        if n > most:
            return float("inf")
        total += packing.SEQUENCE_COST + penalties[b] + (0 if n & (n - 1) == 0 else most - n)
    return total


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    most, total = 16, int(rng.integers(1, 60))
    at = np.unique(np.concatenate([[0, total], np.arange(0, total, 5), rng.integers(0, total + 1, 6)]))
    penalty = rng.integers(0, 40, len(at)).astype(float)
    found = packing.best_windows(at, penalty, most)
    place = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    best = {0: 0.0}
    for b in at.tolist()[1:]:
        best[b] = min((best[a] + cost([a, b], place, most) for a in at.tolist() if a < b), default=float("inf"))
    assert found[0] == 0 and found[-1] == total
    assert cost(found, place, most) == pytest.approx(best[total])


def verify(rows, pieces):
    want = defaultdict(list)
    for r, ids in zip(rows, brute(rows, "word_bpe_49k.json", 2), strict=True):
        want[r[0]].append(ids)
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.length * 4 == len(p.ids)
        spans[p.doc_id].append((p.start, p.length, zlib.crc32(p.ids), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(spans) == set(want)
    for key, found in spans.items():
        copies = len(want[key])
        at = 0
        for start, length, crc, total in sorted(found)[::copies]:
            assert start == at and crc == zlib.crc32(np.array(want[key][0][start : start + length], "<u4").tobytes()) and total == len(want[key][0])
            at += length
        assert at == len(want[key][0])
    waste = used = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.MOST
        used += at
        waste += 0 if at & (at - 1) == 0 else packing.MOST - at
    return waste, used


def test_each_token_lies_in_one_piece(spark):
    rows = [r for r in awkward() if not (r[0] == 4)]
    verify(rows, packing.pack(docs(spark, rows).coalesce(1)).collect())


def test_documents_pack_tightly(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    waste, used = verify(rows, packing.pack(table).collect())
    assert waste < 0.02 * used


def test_no_documents(spark):
    assert packing.pack(docs(spark, [])).count() == 0
