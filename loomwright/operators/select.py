"""Feature selection: fit picks columns, apply drops the others."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomwright.errors import EngineError
from loomwright.operators.base import REQUIRED, col, is_numeric, need, need_numeric, num, numeric_columns, one_row, transform

#: A numeric target of whole numbers with at most so many values is one of classes.
CLASSES = 10
#: Equal-mass bins of a numeric feature for its mutual information with a target.
BINS = 20


def candidates(df, p):
    names = p["columns"] or numeric_columns(df, p.get("target"))
    need_numeric(df, *names)
    if not names:
        raise EngineError("no numeric column to choose from")
    return list(names)


def dropped(df, state):
    return df.drop(*[c for c in state["dropped"] if c in df.columns])


def fit_variance(df, p):
    names = candidates(df, p)
    found = one_row(df, *[F.var_pop(num(c)).alias(f"v{i}") for i, c in enumerate(names)])
    return {"dropped": [c for i, c in enumerate(names) if (found[f"v{i}"] or 0.0) <= p["threshold"]]}


@transform("drop_low_variance", fit=fit_variance, threshold=0.0, columns=None, target=None, streamable=True)
def drop_low_variance(df, p, state):
    return dropped(df, state)


def coded(df, target):
    """The target as a number: codes of sorted labels for text."""
    need(df, target)
    if is_numeric(df, target):
        return num(target)
    values = [r[0] for r in df.where(col(target).isNotNull()).select(col(target).cast("string")).distinct().orderBy(F.asc(target)).limit(1001).collect()]
    if len(values) > 1000:
        raise EngineError(f"target {target!r} has over 1000 classes")
    out = None
    for k, v in enumerate(values):
        out = F.when(col(target).cast("string") == v, float(k)) if out is None else out.when(col(target).cast("string") == v, float(k))
    return out if out is not None else F.lit(None).cast("double")


def fit_correlated(df, p):
    names = candidates(df, p)
    facts = [F.abs(F.corr(num(a), num(b))).alias(f"r{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    if p["target"]:
        y = coded(df, p["target"])
        facts += [F.abs(F.corr(num(c), y)).alias(f"t{i}") for i, c in enumerate(names)]
    found = one_row(df, *facts)
    order = list(range(len(names)))
    if p["target"]:
        order.sort(key=lambda i: -(found[f"t{i}"] or 0.0))
    kept: list[int] = []
    for i in order:
        if all((found[f"r{min(i, j)}_{max(i, j)}"] or 0.0) < p["threshold"] for j in kept):
            kept.append(i)
    return {"dropped": [c for i, c in enumerate(names) if i not in kept]}


@transform("drop_correlated", fit=fit_correlated, threshold=0.9, columns=None, target=None, streamable=True)
def drop_correlated(df, p, state):
    return dropped(df, state)


def task_of(df, target, task):
    if task != "auto":
        return task
    need(df, target)
    if not is_numeric(df, target):
        return "classification"
    row = one_row(df, F.approx_count_distinct(num(target)).alias("n"), F.every(num(target) == F.floor(num(target))).alias("whole"))
    return "classification" if row["whole"] and row["n"] <= CLASSES else "regression"


def f_scores(df, names, target, task):
    """ANOVA F of each column between classes, or F of its linear regression."""
    need(df, target)
    if task == "regression":
        y = num(target)
        found = one_row(df, *[F.corr(num(c), y).alias(f"r{i}") for i, c in enumerate(names)], *[F.count_if(num(c).isNotNull() & y.isNotNull()).alias(f"n{i}") for i, c in enumerate(names)])
        return {c: (r := found[f"r{i}"] or 0.0) ** 2 / max(1e-300, 1 - r * r) * max(0, found[f"n{i}"] - 2) for i, c in enumerate(names)}
    groups = df.where(col(target).isNotNull()).groupBy(col(target).alias("g")).agg(*[f(num(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(x * x)))])
    out = {}
    total = groups.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"k{i}") for i in range(len(names))], *[F.sum(f"{k}{i}").alias(f"{k}{i}") for i in range(len(names)) for k in "nsq"], *[F.sum(F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}"))).alias(f"b{i}") for i in range(len(names))]).first()
    for i, c in enumerate(names):
        n, s, q, b, k = (total[f"{x}{i}"] or 0 for x in "nsqbk")
        between = b - (s * s / n if n else 0)
        within = q - b
        out[c] = 0.0 if k < 2 or n <= k else (between / (k - 1)) / max(1e-300, within / (n - k))
    return out


def binned(df, name, bins=BINS):
    cuts = one_row(df, F.percentile(num(name), F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("q"))["q"] or []
    x, out = num(name), F.lit(0)
    for cut in sorted(set(cuts)):
        out = out + (x > cut).cast("int")
    return F.when(x.isNotNull(), out)


def bins_of(df, names, bins=BINS):
    """Equal-mass bins of numeric columns, from one aggregate: {name: expression}."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = one_row(df, *[F.percentile(num(c), shares).alias(f"q{i}") for i, c in enumerate(names)])
    out = {}
    for i, c in enumerate(names):
        place = F.lit(0)
        for cut in sorted(set(found[f"q{i}"] or [])):
            place = place + (num(c) > cut).cast("int")
        out[c] = F.when(num(c).isNotNull(), place)
    return out


def binned(df, name, bins=BINS):
    return bins_of(df, [name], bins)[name]


def mutual_information(df, features, y):
    """{name: nats shared with y} of discrete expressions, from the counts of all pairs at once."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), x.cast("string").alias("x"), y.alias("y")) for c, x in features.items()])).alias("e")).select("e.*").where("x IS NOT NULL AND y IS NOT NULL")
    pairs = each.groupBy("column", "x", "y").agg(F.count("*").alias("n"))
    by = lambda *keys: pairs.groupBy("column", *keys).agg(F.sum("n").alias("n" + "".join(keys)))
    joined = pairs.join(by("x"), ["column", "x"]).join(by("y"), ["column", "y"]).join(by().withColumnRenamed("n", "total"), "column")
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    found = {r["column"]: max(0.0, r["shared"]) for r in joined.groupBy("column").agg(F.sum(term).alias("shared")).collect()}  # one row a column
    return {c: found.get(c, 0.0) for c in features}


def information_scores(df, names, target, task):
    y = coded(df, target) if task == "classification" else binned(df, target)
    return mutual_information(df, bins_of(df, names), y)


def best(scores, names, k, share):
    count = k if k is not None else math.ceil(len(names) * (share if share is not None else 100) / 100)
    order = sorted(names, key=lambda c: (-scores[c], names.index(c)))
    return order[: max(1, count)]


def fit_k_best(df, p):
    names = candidates(df, p)
    task = task_of(df, p["target"], p["task"])
    scores = (f_scores if p["score"] == "f_test" else information_scores)(df, names, p["target"], task)
    kept = best(scores, names, p["k"], p["percentile"])
    return {"scores": scores, "dropped": [c for c in names if c not in kept]}


@transform("select_k_best", fit=fit_k_best, target=REQUIRED, score="mutual_info", k=None, percentile=None, task="auto", columns=None, random_state=0, streamable=True)
def select_k_best(df, p, state):
    """By F test, or by mutual information of equal-mass bins."""
    return dropped(df, state)


def model_importance(df, names, target, task, model, seed):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    data = df.select(*[num(c).alias(f"f{i}") for i, c in enumerate(names)], coded(df, target).alias("label")).dropna()
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="raw").transform(data)
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data)
    if model == "tree":
        maker = RandomForestClassifier if task == "classification" else RandomForestRegressor
        found = maker(numTrees=30, seed=seed).fit(data).featureImportances.toArray()
    elif task == "classification":
        found = abs(LogisticRegression(elasticNetParam=1.0, regParam=0.01).fit(data).coefficientMatrix.toArray()).max(axis=0)
    else:
        found = abs(LinearRegression(elasticNetParam=1.0, regParam=0.01).fit(data).coefficients.toArray())
    return dict(zip(names, map(float, found), strict=True))


def fit_from_model(df, p):
    names = candidates(df, p)
    scores = model_importance(df, names, p["target"], task_of(df, p["target"], p["task"]), p["model"], p["random_state"])
    ordered = sorted(scores.values())
    middle = ordered[len(ordered) // 2] if len(ordered) % 2 else (ordered[len(ordered) // 2 - 1] + ordered[len(ordered) // 2]) / 2
    bar = p["threshold"]
    bar = 1e-5 if bar is None and p["model"] == "l1" else sum(ordered) / len(ordered) if bar in (None, "mean") else middle if bar == "median" else bar
    kept = [c for c in sorted(names, key=lambda c: -scores[c]) if scores[c] >= bar][: p["max_features"]]
    return {"scores": scores, "dropped": [c for c in names if c not in (kept or names[:1])]}


@transform("select_from_model", fit=fit_from_model, target=REQUIRED, model="l1", threshold=None, max_features=None, task="auto", columns=None, random_state=0, streamable=True)
def select_from_model(df, p, state):
    """By the weights of an L1 model or the importances of a forest (pyspark.ml)."""
    return dropped(df, state)
