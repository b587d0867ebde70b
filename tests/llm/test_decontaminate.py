from __future__ import annotations

import random
from itertools import combinations

import pytest

from loomwright.llm import decontaminate as d
from tests.llm.common import SF, awkward, docs

ITEMS = "item_id long, text string, doc_id string"


def found(spark, rows, items):
    frame = spark.createDataFrame([(i, t, None) for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in d.contaminated(docs(spark, rows), frame).collect()}


def row(i, text):
    return (i, text, "en", "s", 0, None, None)


def test_substitutions_are_tolerated(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, " ".join(f"Item{k}w{rng.randrange(10**6)}," for _ in range(30))) for k in range(40)]
    rows = []
    for k, text in items:
        words = text.split()
        for at in rng.sample(range(30), 3):
            words[at] = "other"
        rows.append(row(k, f"{noise(50)} {' '.join(words).lower()} {noise(50)}"))
        rows.append(row(100 + k, f"{noise(50)} {' '.join(words[:6])} {noise(50)}"))  # too little
    got = found(spark, rows, items)
    assert {p for p in got if p[0] >= 100} == set()
    assert len([1 for k in range(40) if (k, k) in got]) >= 38
    assert all(a == b for a, b in got)


@pytest.mark.parametrize("length", [5, 8, 9, 10, 11, *range(12, 24)])
def test_masks_reach_every_placement_the_bar_allows(length):
    masks = [(len(m), int(m[::-1], 2)) for m in d.masks_for(length)]
    for gone in combinations(range(length), length // 5):
        equal = (1 << length) - 1 - sum(1 << k for k in gone)
        assert any(equal >> at & m == m for n, m in masks for at in range(length - n + 1)), gone


def test_substitutions_up_to_the_bar(spark):
    """Every placement of 3 in 15 words but some, every fifth of any length, and 2 of 10 words; one more is too many."""
    noise = lambda k: " ".join(f"n{k}x{j}" for j in range(30))
    cases = [(15, c) for c in list(combinations(range(15), 3))[::9]]
    cases += [(n, tuple(range(first, n, 5))) for n in (14, 15, 40, 60) for first in (2, 4) if len(range(first, n, 5)) <= n // 5]
    cases += [(10, (2, 7)), (11, (0, 10)), (6, (3,)), (10, (1, 4, 8)), (15, (2, 5, 8, 11)), (5, (1, 3))]
    items, rows, want = [], [], set()
    for k, (n, gone) in enumerate(cases):
        own = [f"i{k}w{j}" for j in range(n)]
        items.append((k, " ".join(own)))
        rows.append(row(k, f"{noise(k)} {' '.join('other' if j in gone else w for j, w in enumerate(own))} {noise(k)}"))
        sub = lambda a, b: sum(a <= g < b for g in gone)
        if any(5 * sub(a, b) <= b - a for a in range(n) for b in range(a + min(12, n), n + 1)):
            want.add((k, k))
    got = found(spark, rows, items)
    assert set(got) == want and len(want) == len(cases) - 3


def test_longest_stretch():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        equal = rng.random(rng.integers(0, 30)) < 0.75
        n = len(equal)
        best = max([b - a for a in range(n) for b in range(a + 1, n + 1) if 5 * int(equal[a:b].sum()) >= 4 * (b - a)], default=0)
        i, j = d.longest_stretch(equal)
        assert j - i == best and 5 * int(equal[i:j].sum()) >= 4 * (j - i)


def test_every_exact_passage_is_found(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts, keys = {r.doc_id: r.text for r in table.collect()}, {r.item_id: r.text for r in items.collect()}
    want = {(i, k) for i, t in texts.items() for k, b in keys.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in d.contaminated(table, items).collect()}
    assert want and want <= got and all(t in want for t in got)


def test_short_items(spark):
    rows = [row(1, "we say five short words only here now"), row(2, "five short words"), row(3, "nothing at all")]
    got = found(spark, rows, [(1, "Five short words, only."), (2, "..."), (3, None), (None, "nothing at all")])
    assert got == {(1, 1): (4, 4)}


def test_awkward_rows(spark):
    item = " ".join(f"t{i}" for i in range(2000, 2040))
    got = found(spark, awkward(), [(7, item), (7, item)])
    assert got == {(12, 7): (40, 40)}
    assert found(spark, [], [(1, item)]) == {} and found(spark, awkward(), []) == {}


def test_best_stretch():
    import numpy as np

    equal = np.array([1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0], dtype=bool)
    assert d.best_stretch(equal, 6, 8) == (5, 15)
