"""The fifteen analyses by id: run(spark, id, params) gives {table name: frame or list of records}."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.analysis import advisor, charts, cleanliness, joins, profile, relations
from loomwright.errors import EngineError, UnknownName
from loomwright.operators.base import RID, numeric_columns
from loomwright.operators.select import f_scores, information_scores, task_of
from loomwright.session import with_rid
from loomwright.sources import load
from loomwright.sources.inspect import inspect

KEYS: dict[str, Callable] = {}


def key(f: Callable) -> Callable:
    KEYS[f.__name__] = f
    return f


def run(spark: SparkSession, name: str, params: dict) -> dict:
    if name not in KEYS:
        raise UnknownName("analysis", name, KEYS)
    given = {} if name == "file_inspect" else {k: frame(spark, v) if k in ("source", "train", "test") or (name == "label_join_preview" and k in ("x", "y")) else v for k, v in params.items()}
    if name == "file_inspect":
        return file_inspect(frame(spark, inspect(spark, params["source"])["load_spec"] or params["source"]), params["source"])
    return KEYS[name](**given)


def frame(spark: SparkSession, source) -> DataFrame:
    df = source if isinstance(source, DataFrame) else load(spark, source)
    return df if RID in df.columns else with_rid(df)


def by_kind(df: DataFrame, found: dict[str, dict] | None = None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c, f in (profile.facts(df) if found is None else found).items():
        out.setdefault(profile.semantic_type(f), []).append(c)
    return out


@key
def dataset_overview(source):
    """Distinct values are counted exactly, whatever the number of rows."""
    facts = profile.facts(source, exact=True)
    kinds = by_kind(source, facts)
    out = {"columns": profile.column_profile(source, found=facts), "head": source.orderBy(RID).limit(10), "alerts": profile.alerts(source, facts)}
    if numbers := kinds.get("numeric"):
        out["numeric_stats"] = profile.numeric_stats(source, numbers)
        out |= {f"histogram:{c}": profile.histogram(source, c) for c in numbers}
    out |= {f"category_values:{c}": profile.category_values(source, c) for c in kinds.get("categorical", ())}
    out |= {f"category_summary:{c}": profile.category_summary(source, c) for c in kinds.get("categorical", ())}
    out |= {f"datetime_stats:{c}": profile.datetime_stats(source, c) for c in kinds.get("datetime", ())}
    out |= {f"text_stats:{c}": profile.text_stats(source, c) for c in kinds.get("text", ())}
    out |= {f"id_stats:{c}": profile.id_stats(source, c) for k in ("id_like", "group_id") for c in kinds.get(k, ())}
    return out


@key
def train_test_check(train, test, target=None):
    shared = [c for c in train.columns if c in test.columns and c != RID]
    kinds = by_kind(train.select(*shared))
    counters = [relations.row_counter(d, shared) for d in (train, test)]
    counted = [c for c in shared if all(r.get(c) for r in counters)]
    ids = [c for k in ("id_like", "group_id") for c in kinds.get(k, ())]
    out = {
        "columns": relations.compare_columns(train, test), "overlap": relations.row_overlap(train, test, [c for c in shared if c not in ids + counted] or shared),
        "id_overlap": relations.id_overlap(train, test, ids), "issues": relations.issues(train, test, target), "align": relations.align_report(train, test, target),
    }
    if numbers := [c for c in kinds.get("numeric", ()) if c in numeric_columns(test)]:
        out["numeric_drift"] = relations.numeric_drift(train, test, numbers)
        out |= {f"histogram_pair:{c}": relations.histogram_pair(train, test, c) for c in numbers}
    for c in kinds.get("categorical", ()):
        out[f"categorical_drift:{c}"] = relations.categorical_shift(train, test, c)
        out[f"unseen:{c}"] = relations.unseen_values(train, test, c)
        out[f"near_matches:{c}"] = relations.near_matches(train, test, c)
    return out


@key
def missing_values(source, test=None):
    out = {"missing_rates": cleanliness.missing_rates(source), "missing_per_row": cleanliness.missing_per_row(source), "sentinels": cleanliness.sentinel_counts(source), "cooccurrence_pairs": cleanliness.cooccurrence(source)}
    if test is not None:
        out |= {f"test_value_spikes:{c}": cleanliness.value_spikes(source, test, c) for c in numeric_columns(source) if c in test.columns}
    out["suggested_steps"] = [s for s in advisor.recommend(source) if s["op"] in ("impute", "drop_columns", "replace_sentinels")]
    return out


@key
def outliers(source, columns=None, method="all"):
    names = columns or numeric_columns(source)
    out = {"outliers_per_column": cleanliness.univariate_outliers(source, names), "box_stats": cleanliness.box_stats(source, names)}
    out |= {f"outlier_values:{c}": cleanliness.outlier_values(source, c) for c in names}
    if method in ("all", "isolation_forest"):
        out["flagged_rows"] = cleanliness.isolation_scores(source, names, RID).orderBy("score", ascending=False).limit(20)
    return out


@key
def duplicates(source, subset=None, id_column=None):
    subset = subset or profile.names_of(source)
    out = {"exact": cleanliness.exact_duplicates(source, subset), "groups": cleanliness.duplicate_groups(source, subset, RID)}
    if id_column:
        out["conflicting_columns"] = cleanliness.conflicts(source, id_column)
    return out


@key
def inconsistencies(source):
    kinds = by_kind(source)
    texts = kinds.get("categorical", []) + kinds.get("text", [])
    out = {f"variants:{c}": cleanliness.variants(source, c, RID) for c in texts}
    for c in kinds.get("categorical", ()):
        try:
            out[f"fuzzy:{c}"] = cleanliness.fuzzy_variants(source, c)
        except EngineError as refused:
            out[f"fuzzy:{c}"] = [{"refused": str(refused)}]
    out |= {f"mixed_types:{c}": cleanliness.mixed_types(source, c) for c in texts}
    out |= {f"ambiguous_dates:{c}": cleanliness.ambiguous_dates(source, c) for c in texts}
    out["text_facts"] = cleanliness.text_facts(source)
    out |= {f"date_formats:{c}": cleanliness.date_formats(source, c) for c in texts}
    return out


@key
def correlations(source, columns=None, method="pearson", threshold=0.9, target=None):
    names = columns or numeric_columns(source, target)
    if method == "pearson":
        return {"matrix": relations.pearson(source, names), "pairs": relations.correlated_pairs(source, names, threshold, target)}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = (lambda a, b: relations.spearman(source, a, b).first()["corr"]) if method == "spearman" else lambda a, b: relations.kendall(source, a, b)
    return {"matrix": [{"a": a, "b": b, "corr": one(a, b)} for a, b in pairs]}


@key
def column_distribution(source, column, by, bins=None, top=10):
    if column in numeric_columns(source):
        row = source.selectExpr(f"min(`{column}`) AS a", f"max(`{column}`) AS b").first()
        n = bins or relations.suggested_bins(source, column)
        edges = [row["a"] + (row["b"] - row["a"]) * k / n for k in range(n)] + [row["b"]]
        out = {"histograms": relations.numeric_distribution(source, column, by, edges), "numeric_summary": relations.numeric_by_class(source, column, by)}
        return out | ({"vs_by": relations.vs_by(source, column, by), "scatter": charts.points(source, by, column)} if by in numeric_columns(source) else {})
    return {"value_counts": relations.categorical_distribution(source, column, by, top)}


@key
def target_analysis(source, target):
    kinds = by_kind(source)
    numbers, words = [c for c in kinds.get("numeric", ()) if c != target], [c for c in kinds.get("categorical", ()) if c != target]
    out = {"ranking": relations.association(source, numbers + words, target), "class_balance": relations.class_balance(source, target)}
    out |= {f"numeric_by_class:{c}": relations.numeric_by_class(source, c, target) for c in numbers}
    out |= {f"class_rates:{c}": relations.class_rates(source, c, target) for c in words}
    return out


@key
def feature_selection(source, target, task="auto"):
    names = numeric_columns(source, target)
    task = task_of(source, target, task)
    f, mi = f_scores(source, names, target, task), information_scores(source, names, target, task)
    rank = lambda s: {c: k + 1 for k, c in enumerate(sorted(names, key=lambda c: -s[c]))}
    a, b = rank(f), rank(mi)
    return {"scores": [{"column": c, "f": f[c], "mutual_info": mi[c], "combined_rank": (a[c] + b[c]) / 2} for c in sorted(names, key=lambda c: a[c] + b[c])], "collinear_pairs": relations.correlated_pairs(source, names, 0.9, target), "near_constant": relations.near_constant(source, [c for c in profile.names_of(source) if c != target]), "pca_variance": relations.pca_variance(source, names)}


@key
def preprocessing_advisor(source, target=None, model="linear", test=None):
    return {"recommendations": advisor.recommend(source, target, model, test)}


@key
def impute_benchmark(source, columns, strategies=("median", "mean", "most_frequent")):
    return {"scores": advisor.impute_benchmark(source, columns, strategies)}


@key
def label_join_preview(x, y, key=None):
    shared = [c for c in x.columns if c in y.columns and c != RID]
    wanted = [key] if key else shared
    if not wanted:
        raise EngineError("the two sides share no column; join by order")
    return {"candidates": {c: joins.key_diagnostics(x, y, c) for c in wanted}, "shapes": [{"side": s, "rows": d.count(), "columns": len(d.columns) - 1} for s, d in (("x", x), ("y", y))]}


@key
def file_inspect(source, written):
    found = inspect(source.sparkSession, written)
    return found | {"rows": [{"rows": source.count()}], "head": source.orderBy(RID).limit(10)}


@key
def chart(source, kind, x, y=None, how="count", color=None):
    if kind == "scatter":
        return {"points": charts.points(source, x, y), "trend": charts.trend(source, x, y)}
    if kind == "density":
        return {"grid": charts.density(source, x, y)}
    data = charts.aggregated(source, x, y, how, color)
    return {"data": data, "figure": charts.figure(kind, [r.asDict() for r in data.orderBy(x).limit(charts.SAMPLE).collect()], x, color=color)}


