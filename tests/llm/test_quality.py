from __future__ import annotations

import pytest

from loomwright.llm import quality
from tests.llm.common import SF, awkward, docs, words

SYMBOLS = set("#*$%&|<>")


def brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {i + k for i, x in enumerate(windows) if x in twice for k in range(8)}
    own = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(own) - len(set(own)), len(hit)


def check(frame, rows):
    counted = quality.features(frame)
    got = sorted(((r.doc_id, r.__getitem__("__n_words"), r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) for r in counted.collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_counts_of_awkward_documents(spark):
    check(docs(spark), awkward())


def test_counts_of_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    check(table, [(r.doc_id, r.text) for r in table.collect()])


def verdicts(spark, rows):
    counted = quality.features(docs(spark, rows))
    return {r["doc_id"]: (r["__base_failed"], r["__kept"]) for r in quality.judge(counted, quality.thresholds(quality.sketch(counted))).collect()}


def test_junk_goes_and_clean_documents_stay(spark):
    clean = " ".join(f"word{i * 31 % 997}" for i in range(90)) + "."
    junk = " ".join(f"wo{i * 31 % 997}$$$" for i in range(90))
    rows = [(i, junk if i % 10 == 0 else f"{clean} and number {i}", "en", f"s{i % 2}", 0, None, None) for i in range(1000)]
    found = verdicts(spark, rows)
    assert all(found[i] == (False, i % 10 != 0) for i in range(1000))


def test_sources_get_their_own_limits(spark):
    """Source a has no symbols, source b 5 to 9 % of them: a tenth is too much for a alone."""
    plain = lambda i, n: [f"word{i * 7 % 89}x{k * 31 % 997}" for k in range(n)]
    marked = lambda i, every: " ".join(w + "#" * (k % every == 0) for k, w in enumerate(plain(i, 90)))
    rows = [(i, " ".join(plain(i, 90)), "en", "a", 0, None, None) for i in range(250)]
    rows += [(1000 + i, marked(i, 1 + i % 2), "en", "b", 0, None, None) for i in range(250)]
    rows += [(2000, marked(3, 1), "en", "a", 0, None, None), (2001, marked(3, 1), "en", "b", 0, None, None)]
    counted = quality.features(docs(spark, rows))
    limits = {r["source"]: r for r in quality.thresholds(quality.sketch(counted)).collect()}
    assert limits["a"]["__max_symbol_share"] == pytest.approx(0.04) and 0.2 < limits["b"]["__max_symbol_share"] <= 0.3
    assert limits["a"]["__max_word_length"] < limits["b"]["__max_word_length"] < 15
    found = verdicts(spark, rows)
    assert found[2000] == (False, False) and found[2001] == (False, True)
    assert all(found[i][1] for i in found if i not in (2000,))


def test_base_rules_and_nulls(spark):
    found = verdicts(spark, awkward())
    assert found[0] == (True, False) and found[1] == (True, False) and found[5] == (True, False)
    assert found[6] == (False, True) and found[None] == (False, True)
    assert len(found) == len({r[0] for r in awkward()})


def test_sketches_merge(spark):
    table = docs(spark, [(i, " ".join(["abc def#"] * (10 + i % 40)) + f" {i} x" * 11, "en", f"s{i % 3}", 0, None, None) for i in range(300)])
    counted = quality.features(table)
    a, b = (quality.sketch(counted.where(f"doc_id % 2 = {k}")) for k in (0, 1))
    parts = {tuple(r) for r in quality.merge(a.union(b), "lang").collect()}
    assert parts == {tuple(r) for r in quality.merge(quality.sketch(counted), "lang").collect()}


def test_sketch_is_within_two_percent(spark):
    import numpy as np

    sizes = list(range(20, 520))
    rows = [(i, " ".join("ab" if k % 5 else "ab#" for k in range(n)), "en", "s", 0, None, None) for i, n in enumerate(sizes)]
    counted = quality.features(docs(spark, rows)).withColumn("__n_repeat_words", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    found = {r.rule: (r.q25, r.q75) for r in quality.quartiles(quality.merge(quality.sketch(counted))).collect()}
    share = [sum(1 for k in range(n) if k % 5 == 0) / (2 * n + sum(1 for k in range(n) if k % 5 == 0)) for n in sizes]
    for got, p in zip(found["symbol_share"], (25, 75), strict=True):
        assert got == pytest.approx(np.percentile(share, p), rel=0.02)


def test_no_documents(spark):
    assert verdicts(spark, []) == {}
