from __future__ import annotations

import numpy as np
import pytest
import xxhash

from loomwright.llm import simhash
from loomwright.llm.components import connected
from tests.llm.common import SF, awkward, docs, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_print(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for key in sorted(k for k in prints if k is not None):
        low.setdefault(find(prints[key]), key)
    return {k: low.get(find(p)) for k, p in prints.items()}


@pytest.mark.parametrize("budget", [0, 1, 2, 5])
def test_trie_finds_every_pair(budget):
    """Two subtrees walked together: each finds its own pairs, none across."""
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**16, 40)
    keys = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 16, 40)), base ^ (1 << rng.integers(0, 16, 40)) ^ (1 << rng.integers(0, 16, 40))])).astype(np.uint64)
    for shift in (48, 0):
        own = keys << np.uint64(shift)
        roots = np.array([0, len(keys), len(keys) + 1, 2 * len(keys) + 1])
        found = [p for a, b in simhash.trie_pairs(np.concatenate([own, own[:1], own]), roots, 0, budget) for p in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (int(keys[i]) ^ int(keys[j])).bit_count() <= budget}
        assert len(found) == len(set(found))
        assert {tuple(sorted(p)) for p in found} == want | {(i + len(keys) + 1, j + len(keys) + 1) for i, j in want}


def test_parts_of_a_hot_subtree_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "WALK", 64)
    rng = np.random.default_rng(5)
    fps = {int(f) for f in 0x123456 << 40 | rng.integers(0, 1 << 12, 300)}
    fps |= {int(f) for f in rng.integers(-(2**63), 2**63, 200)}
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "id long, fp long")
    got = {r.node: r.component for r in connected(simhash.links(nodes)).collect()}
    want = brute_components({i: f % 2**64 for i, f in enumerate(sorted(fps))})
    assert {i: got.get(i, i) for i in want} == want


def check(frame, rows):
    prints = {r[0]: brute_print(r[1]) for r in rows}
    want = brute_components(prints)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == {k: (p, want[k]) for k, p in prints.items()}


def test_awkward_documents(spark):
    check(docs(spark), awkward())


def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    check(table, [(r.doc_id, r.text) for r in table.collect()])


def test_planted_fingerprints(spark):
    rng = np.random.default_rng(9)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 50)]
    for f in fps[:20]:
        chain = f
        for _ in range(8):
            chain ^= 1 << int(rng.integers(0, 63))
            fps.append(chain)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.node: r.component for r in connected(simhash.links(nodes)).collect()}
    want = brute_components({i: f % 2**64 for i, f in enumerate(fps)})
    assert {i: got.get(i, i) for i in want} == want


def test_long_path(spark):
    table = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 950)], "a long, b long")
    got = {r.node: r.component for r in connected(table).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900, 950: 900}


def test_no_documents(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
