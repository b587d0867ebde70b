from __future__ import annotations

import random

import pytest

import corpus_pipeline
from loomwright.llm import quality, similar
from tests.llm.common import SF, awkward, docs, words
from tests.llm.test_simhash import lower


def row(i, text):
    return (i, text, "en", "s", len(text), None, None)


def gram(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def edited(rng, w, share):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else x for x in w]


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(60):
        base = [f"b{g}x{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 130, 400, 1500]))]
        rows += [row(10 * g + k, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.06, 0.2]) if k else 0))) for k in range(6)]
    rows.append(row(5000, "a b"))
    rows.append(row(5001, "A  b"))
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows)).collect()}
    sets = {r[0]: gram(r[1]) for r in rows}
    sure = wrong = missed = 0
    for i in sets:
        for j in sets:
            if i < j and (i // 10 == j // 10):
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.85:
                    sure += 1
                    missed += got[i] != got[j]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.72 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    wrong = sum(find(i) != find(c) for i, c in got.items())
    assert sure > 100 and missed <= 0.01 * sure and wrong == 0


def test_the_bar_itself(spark):
    """Pairs of 0.80 or little more are linked, pairs just below are not; short texts too."""
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(160):
        n = rng.choice([8, 9, 10, 12, 14, 20, 60, 150, 500])
        base = [f"p{k}x{rng.randrange(10**6)}" for _ in range(n)]
        other = list(base)
        # Words at the end go one by one until the index is at the bar; of every second pair one goes beyond it.
        while len(gram(" ".join(other[:-1]))) >= 0.8 * len(gram(" ".join(base))):
            other.pop()
        if k % 2:
            other.pop()
        a, b = gram(" ".join(base)), gram(" ".join(other))
        rows += [row(2 * k, " ".join(base)), row(2 * k + 1, " ".join(other))]
        want[2 * k + 1] = 2 * k if len(a & b) / len(a | b) >= 0.8 else 2 * k + 1
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows)).collect()}
    wrong = {i for i in want if got[i] != want[i] and want[i] == i}
    missed = {i for i in want if got[i] != want[i] and want[i] != i}
    assert not wrong and len(missed) <= 1


def test_hot_groups_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(similar, "GROUP", 7)
    rng = random.Random(6)
    base = [f"b{rng.randrange(500)}" for _ in range(300)]
    rows = [row(i, " ".join(edited(rng, base, 0.004))) for i in range(80)] + [row(100, " ".join(f"o{k}" for k in range(300)))]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows)).collect()}
    assert got == {**dict.fromkeys(range(80), 0), 100: 100}


def test_candidates_of_the_trie(spark, monkeypatch):
    """Texts within the budget of the fingerprints' trie meet without any key in common; the Jaccard index decides all the same."""
    rng = random.Random(8)
    rows = []
    for k in range(30):
        base = [f"t{k}x{rng.randrange(10**6)}" for _ in range(2000)]
        rows += [row(10 * k + j, " ".join(base[: len(base) - j])) for j in range(4)]
    sets = {r[0]: gram(r[1]) for r in rows}
    prints = {i: similar.majority(*similar.shingles([text.encode()], similar.SHINGLE))[0] for i, text, *_ in rows}
    close = lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= similar.BUDGET
    want = {i: next((j for j in sorted(sets) if j // 10 == i // 10 and j < i and close(i, j)), None) for i in sets}
    monkeypatch.setattr(similar, "keys", lambda hashes, bounds, similarity: [[] for _ in bounds[1:]])
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows)).collect()}
    assert sum(j is not None for j in want.values()) >= 60
    assert all(got[i] == got[j] < i for i, j in want.items() if j is not None)
    alone = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows), similarity=1.0).collect()}
    assert alone == {i: i for i in sets}


@pytest.mark.parametrize("rows", [None, []])
def test_stages_keep_the_columns(spark, rows):
    frame = docs(spark, rows)
    for given in (frame, frame.drop("n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, SF)
            assert out.columns == given.columns and [f.dataType for f in out.schema] == [f.dataType for f in given.schema]
            assert out.count() <= len(awkward())
    assert (corpus_pipeline.packed(spark, frame, SF).count() == 0) == (rows == [])


def test_run_over_documents(spark):
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in pieces}
    assert kept < set(source)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in source[i].text for i in kept for b in items)
    texts = [lower(source[i].text).split() for i in sorted(kept)]
    assert len({" ".join(t) for t in texts}) == len(texts)
    clean = [i for i, r in source.items() if len(words(r.text)) >= 100 and not set(r.text) & set("#*$%&|<>") and not any(b in r.text for b in items)]
    lone = [i for i in clean if not any(j != i and len(gram(source[i].text) & gram(source[j].text)) >= 0.7 * len(gram(source[i].text) | gram(source[j].text)) for j in source)]
    lone = [i for i in lone if len(set(x := source[i].text.split("\n"))) == len(x)]
    lone = [i for i in lone if 100 * int(quality.counts([source[i].text.encode()])["n_repeat_words"][0]) <= 30 * len(words(source[i].text))]
    assert len(lone) > 20 and set(lone) <= kept
