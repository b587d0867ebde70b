from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright import keys
from loomwright.analysis import advisor, cleanliness, profile, relations
from loomwright.errors import EngineError
from loomwright.functions.running import ranged_quantiles


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, 1000 + i, rng.gauss(3 * y, 1), rng.gauss(0, 1) if i % 7 else None, rng.choice(["low", "high", "medium"]), "2024-01-%02d" % (i % 28 + 1), rng.choice(["Paris", "paris ", "Lyon"]), "yes" if y else "no"))
    return spark.createDataFrame(rows, "_rid long, id long, signal double, noise double, level string, day string, city string, y string")


PARAMS = {
    "dataset_overview": {}, "missing_values": {}, "outliers": {"columns": ["signal", "noise"]}, "duplicates": {"subset": ["city"]}, "inconsistencies": {}, "correlations": {"columns": ["signal", "noise"]},
    "column_distribution": {"column": "signal", "by": "y"}, "target_analysis": {"target": "y"}, "feature_selection": {"target": "y"}, "preprocessing_advisor": {"target": "y"}, "impute_benchmark": {"columns": ["signal"]},
    "file_inspect": {}, "chart": {"kind": "bar", "x": "level", "y": "signal", "how": "mean"},
}


def found(spark, df, name):
    return keys.run(spark, name, {"source": df, **PARAMS[name]})


def as_dicts(frame, key="column"):
    return {r[key]: r.asDict() for r in frame.collect()}


def test_overview(spark, df):
    out = found(spark, df, "dataset_overview")
    columns = as_dicts(out["columns"])
    assert columns["noise"]["missing"] == 43 and columns["id"]["n_unique"] == 300 and columns["level"]["semantic"] == "categorical"
    assert out["head"].count() == 10 and {"alert": "id_like", "column": "id"} in out["alerts"]
    values = as_dicts(out["category_values:level"], "value")
    assert sum(v["count"] for v in values.values()) == 300 and sum(v["pct"] for v in values.values()) == pytest.approx(100)
    assert out["histogram:signal"].agg({"count": "sum"}).first()[0] == 300
    assert as_dicts(out["numeric_stats"])["noise"]["count"] == 257


def test_missing_and_outliers(spark, df):
    out = found(spark, df, "missing_values")
    assert as_dicts(out["missing_rates"])["noise"]["advice"] == "impute"
    assert any(s["op"] == "impute" and s["params"]["columns"] == ["noise"] for s in out["suggested_steps"])
    out = found(spark, df, "outliers")
    box = as_dicts(out["box_stats"])["signal"]
    far = out["outlier_values:signal"].collect()
    assert sum(r["count"] for r in far) == min(20, box["below"] + box["above"]) and out["flagged_rows"].count() == 20
    assert as_dicts(out["outliers_per_column"])["signal"]["n"] == 300


def test_duplicates_and_spellings(spark, df):
    out = found(spark, df, "duplicates")
    row = out["exact"].first()
    assert (row["redundant"], row["involved"], row["groups"]) == (297, 300, 3) and out["groups"].select("group").distinct().count() == 3
    firsts = out["groups"].groupBy("group").agg({"_rid": "min"}).orderBy("group").collect()
    assert [r[0] for r in firsts] == [1, 2, 3] and [r[1] for r in firsts] == sorted(r[1] for r in firsts)
    out = found(spark, df, "inconsistencies")
    assert {r["value"] for r in out["variants:city"].collect()} == {"Paris", "paris "} and out["fuzzy:level"] == []


def test_relations(spark, df):
    out = found(spark, df, "correlations")
    assert out["matrix"].count() == 1 and out["pairs"].count() == 0
    out = found(spark, df, "column_distribution")
    assert out["histograms"].agg({"count": "sum"}).first()[0] == 300
    ranking = as_dicts(found(spark, df.drop("id"), "target_analysis")["ranking"])
    assert ranking["signal"]["rank"] == 1 and ranking["signal"]["strength"] > 0.7 and ranking["signal"]["measure"] == "eta" and ranking["level"]["f"] is None
    assert as_dicts(found(spark, df, "impute_benchmark")["scores"], "strategy")["median"]["n"] > 0
    out = found(spark, df, "feature_selection")
    assert out["near_constant"].count() == 0 and out["pca_variance"].agg({"share": "sum"}).first()[0] == pytest.approx(1)
    assert {t["name"] for t in found(spark, df, "file_inspect")["columns"]} == set(df.columns) - {"_rid"}
    assert len(found(spark, df, "chart")["figure"]["data"][0]["x"]) == 3


def test_two_frame_keys(spark, df):
    assert len(keys.KEYS) == 15
    train, test = df.where("_rid < 200"), df.where("_rid >= 200").withColumn("level", F.expr("CASE WHEN _rid = 250 THEN ' High.' WHEN _rid = 251 THEN 'new' ELSE level END")).withColumn("signal", F.col("signal") + 4)
    out = keys.run(spark, "train_test_check", {"train": train, "test": test})
    assert out["overlap"].first().overlap == 0
    drift = as_dicts(out["numeric_drift"])
    assert drift["signal"]["severity"] == "high" and drift["signal"]["mean_test"] > drift["signal"]["mean_train"] + 3 and drift["noise"]["skipped"] is None
    assert [tuple(r) for r in out["near_matches:level"].collect()] == [(" High.", "high")]
    assert as_dicts(out["id_overlap"])["id"]["n_test_in_train"] == 0
    grave = {(r["column"], r["issue"]): r["severity"] for r in out["issues"].collect()}
    assert grave["signal", "drift"] == "high" and grave["level", "value_mismatch"] == "high"
    assert out["histogram_pair:signal"].agg({"train": "sum", "test": "sum"}).first()[0] == pytest.approx(1)
    y = df.select("id", "y")
    assert keys.run(spark, "label_join_preview", {"x": df.drop("y"), "y": y})["candidates"]["id"].first().would_join == 1
    with pytest.raises(EngineError):
        keys.run(spark, "overview", {})


def test_semantic_types(df):
    kinds = {c: profile.semantic_type(f) for c, f in profile.facts(df).items()}
    assert kinds == {"id": "id_like", "signal": "numeric", "noise": "numeric", "level": "categorical", "day": "datetime", "city": "categorical", "y": "categorical"}


def test_advice(spark, df):
    steps = keys.run(spark, "preprocessing_advisor", {"source": df, "target": "y"})["recommendations"]
    assert any(s["op"] == "drop_columns" and s["params"]["columns"] == ["id"] and s["category"] == "leak" for s in steps)
    assert any(s["op"] == "ordinal" and s["params"]["categories"]["level"] == ["low", "medium", "high"] for s in steps)
    assert any(s["op"] == "impute" and s["params"]["columns"] == ["noise"] for s in steps)
    assert [s["op"] for s in steps if s["params"].get("column") == "day" or s["params"].get("columns") == ["day"]] == ["datetime_parts", "drop_columns"]


def test_ten_reasons_to_leave_a_column_out(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = rng.gauss(0, 1)
        rows.append((i, f"K{i}", [i], bytearray([i % 7]), y * 2, y * 3 + 0.01, 1.0 if i % 5 == 0 else None, 5, 1000 + i % 120, f"free {'Words' if i % 2 else 'words'} no {i // 2}", f"{i % 28 + 1} Mar {1900 + i}", rng.choice("abc"), y))
    train = spark.createDataFrame(rows, "_rid long, name string, list array<int>, raw binary, price_mean double, twin double, rare double, same int, shop long, note string, day string, kind string, price double")
    steps = advisor.recommend(train.withColumn("later", F.rand(1)), "price", test=train.drop("price"))
    why = {s["params"]["columns"][0]: (s["op"], s["category"]) for s in steps if s["category"] in ("leak", "drop", "consistency")}
    assert why == {
        "later": ("drop_columns", "leak"), "name": ("drop_columns", "leak"), "list": ("drop_columns", "drop"), "raw": ("drop_columns", "drop"), "price_mean": ("drop_columns", "leak"), "twin": ("drop_columns", "leak"),
        "rare": ("drop_columns", "drop"), "same": ("drop_columns", "drop"), "shop": ("drop_columns", "leak"), "note": ("standardize_text", "consistency"), "day": ("parse_dates", "consistency"),
    }


def test_ordered_words(spark):
    for words in (("strongly disagree", "neutral", "agree"), ("xxl", "s", "m"), ("very low", "high")):
        df = spark.createDataFrame([(i, words[i % len(words)].title()) for i in range(60)], "_rid long, c string")
        order = next(s for s in advisor.recommend(df) if s["op"] == "ordinal")["params"]["categories"]["c"]
        assert order == [w.title() for w in next(o for o in advisor.ORDERS if set(words) <= set(o)) if w in words]


def test_signals_rank_first(spark, df):
    scores = keys.run(spark, "feature_selection", {"source": df.drop("id"), "target": "y"})["scores"]
    assert scores[0]["column"] == "signal"


def test_fuzzy_and_indel(spark):
    assert cleanliness.indel_ratio("abcd", "abd") == pytest.approx(100 * 6 / 7)
    df = spark.createDataFrame([(v,) for v in ["san francisco"] * 3 + ["san fransisco", "lyon"]], "c string")
    assert cleanliness.fuzzy_variants(df, "c") == [["san francisco", "san fransisco"]]


def test_missing_spike(spark):
    rows = [(i, *([None] * 3 if i < 60 else [1.0] * 3), 1.0, 2.0) for i in range(200)]
    found = {r.missing: (r.rows, r.spike) for r in cleanliness.missing_per_row(spark.createDataFrame(rows, "_rid long, a double, b double, c double, d double, e double")).collect()}
    assert found[3] == (60, 1) and found[0] == (140, 0)


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_kendall(spark, block):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "a double, b double")
    assert relations.kendall(df, "a", "b", block) == pytest.approx(4 / 6)
    rng = random.Random(2)
    rows = [(float(rng.randrange(9)), float(rng.randrange(12))) for _ in range(150)]
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    want = sum(x * y for x, y in pairs) / (sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs)) ** 0.5
    assert relations.kendall(spark.createDataFrame(rows, "a double, b double"), "a", "b", block) == pytest.approx(want)


def test_ranged_quantiles(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 9) for _ in range(500)] + [1.5] * 60
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    assert ranged_quantiles(df, F.col("x"), shares) == pytest.approx(list(np.quantile(values, shares)))
    assert ranged_quantiles(df.where("x IS NULL"), F.col("x"), shares) is None


def test_stats_of_many_distinct_values(spark, monkeypatch):
    """Places instead of one task's table of values give the same."""
    df = spark.range(3000).selectExpr("id", "CAST(id * 7919 % 3001 AS double) AS x", "CAST(NULL AS double) AS none")
    here = profile.numeric_stats(df, ["x", "none"]).collect()
    monkeypatch.setattr(profile, "PLACED_DISTINCT", 10)
    assert profile.numeric_stats(df, ["x", "none"]).collect() == here and here[1]["count"] == 0


def test_many_spellings_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cleanliness, "FUZZY_MOST", 3)
    with pytest.raises(EngineError):
        cleanliness.fuzzy_variants(spark.createDataFrame([(w,) for w in "abcde"], "c string"), "c")


def test_few_distinct_values_are_counted_exactly(spark, monkeypatch):
    """Above EXACT_ROWS an estimate of at most EXACT_DISTINCT is replaced by the exact count; a larger one stays."""
    monkeypatch.setattr(profile, "EXACT_ROWS", 1_000)
    monkeypatch.setattr(profile, "EXACT_DISTINCT", 10_000)
    df = spark.range(40_000).selectExpr("id", "id % 2406 AS few", "cast(id % 7001 AS string) AS names", "cast(NULL AS int) AS none")
    got = profile.facts(df)
    assert (got["few"]["distinct"], got["names"]["distinct"], got["none"]["distinct"]) == (2406, 7001, 0)
    assert 36_000 <= got["id"]["distinct"] <= 40_000
    assert {r["column"]: r["n_unique"] for r in profile.column_profile(df, exact=True).collect()} == {"id": 40_000, "few": 2406, "names": 7001, "none": 0}


def test_overview_counts_exactly_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(profile, "EXACT_ROWS", 1_000)
    monkeypatch.setattr(profile, "EXACT_DISTINCT", 1_000)
    df = spark.range(20_000).selectExpr("id AS _rid", "id", "id % 7001 / 4.0 AS price")
    columns = as_dicts(keys.run(spark, "dataset_overview", {"source": df})["columns"])
    assert (columns["id"]["n_unique"], columns["price"]["n_unique"], columns["id"]["semantic"]) == (20_000, 7001, "id_like")
