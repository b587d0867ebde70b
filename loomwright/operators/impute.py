"""Filling missing values."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError
from loomwright.functions import groups
from loomwright.functions.formula import compile_formula
from loomwright.operators.base import INTEGRAL, NUMERIC, REQUIRED, col, kind, need, need_numeric, num, row_order, transform, with_values
from loomwright.session import shared_folder

#: Rows of a block in which impute_knn searches at once.
TRAIN_BLOCK, ASKED_BLOCK = 10_000, 256
#: Asked rows whose distances to a block are found together.
KNN_STEP = 64
MISSING = "MISSING"
STATISTICS = ("median", "mean", "most_frequent")


def statistic(df, name, strategy):
    numeric = isinstance(kind(df, name), NUMERIC)
    if strategy == "most_frequent":
        row = df.where(col(name).isNotNull()).groupBy(col(name).alias("v")).count().orderBy(F.desc("count"), F.asc("v")).first()
        return None if row is None else row["v"]
    if not numeric:
        raise EngineError(f"column {name!r} is not numeric: {strategy} has no meaning")
    return df.agg((F.median if strategy == "median" else F.avg)(num(name))).first()[0]


def fit_impute(df, p):
    need(df, *p["columns"])
    strategy, out = p["strategy"], {}
    if strategy in ("formula", "constant"):
        if strategy == "formula" and (len(p["columns"]) != 1 or not p["expr"]):
            raise EngineError("impute by formula takes one column and expr")
        return {}
    use = strategy if strategy in STATISTICS else p["fallback"]
    for name in p["columns"] if use else ():
        value = statistic(df, name, use)
        if value is None:
            raise EngineError(f"column {name!r} has no value to learn from")
        out[name] = value if isinstance(value, (int, float, str, bool)) else str(value)
    return {"values": out}


def filled(df, name, value):
    """coalesce with a literal; a bigint column stays one if the value is whole."""
    x, dtype = col(name), kind(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        x = F.when(~F.isnan(x), x)
    if isinstance(dtype, INTEGRAL) and isinstance(value, float) and not float(value).is_integer():
        return F.coalesce(x.cast("double"), F.lit(value))
    if isinstance(dtype, T.StringType):
        return F.coalesce(x, F.lit(str(value)))
    return F.coalesce(x, F.lit(value).cast(dtype))


@transform("impute", fit=fit_impute, columns=REQUIRED, strategy="median", fill_value=None, expr=None, by=None, order=None, fallback=None, add_indicator=False)
def impute(df, p, state):
    """median, mean, most_frequent (ties: the smallest), constant, formula, group_mean, group_prev or group_interp."""
    need(df, *p["columns"])
    out, flags, strategy = {}, {}, p["strategy"]
    for name in p["columns"]:
        if p["add_indicator"]:
            flags[f"{name}_was_missing"] = (F.isnan(col(name)) | col(name).isNull() if isinstance(kind(df, name), (T.DoubleType, T.FloatType)) else col(name).isNull()).cast("int")
        if strategy in STATISTICS:
            out[name] = filled(df, name, state["values"][name])
        elif strategy == "constant":
            numeric = isinstance(kind(df, name), NUMERIC)
            out[name] = filled(df, name, p["fill_value"] if p["fill_value"] is not None else 0 if numeric else MISSING)
        elif strategy == "formula":
            out[name] = F.coalesce(num(name), compile_formula(p["expr"], df))
        elif strategy in ("group_mean", "group_prev", "group_interp"):
            need(df, p["by"], *([p["order"]] if strategy != "group_mean" else []))
            by = col(p["by"])
            x = num(name) if isinstance(kind(df, name), NUMERIC) else col(name)
            if strategy == "group_mean":
                own = groups.group_mean(x, by)
            else:
                own = getattr(groups, strategy)(x, by, groups.order_key(df, p["order"]), row_order(df))
            value = F.coalesce(x, own)
            if p["fallback"]:
                value = F.coalesce(value, F.lit(state["values"][name]).cast("double" if isinstance(kind(df, name), NUMERIC) else "string"))
            out[name] = value
        else:
            raise EngineError(f"unknown strategy {strategy!r}")
    return with_values(df, out | flags)


def knn_blocks(rows, width: int, most: int):
    """(n, keys, x): rows (key, c0 ..) in blocks of at most `most`, x as float64 rows of `width`, missing as NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: pa.Table) -> pa.RecordBatch:
            x = np.column_stack([held.column(f"c{i}").to_numpy() for i in range(width)]).astype(float)
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([held.column("key").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["n", "keys", "x"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if size == most:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "n long, keys binary, x binary")


def knn_rows(df, names):
    """(key, c0 ..): numbers of every row; the key is a hash that settles ties."""
    key = F.xxhash64(*[F.coalesce(num(c), F.lit(-1e300)) for c in names])
    return df.select(key.alias("key"), *[num(c).alias(f"c{i}") for i, c in enumerate(names)])


def fit_knn(df, p):
    names = list(p["columns"])
    need_numeric(df, *names)
    some = F.coalesce(*[F.col(f"c{i}") for i in range(len(names))]).isNotNull()
    path = f"{shared_folder(df.sparkSession)}/knn-{uuid.uuid4().hex}"
    knn_blocks(knn_rows(df, names).where(some), len(names), TRAIN_BLOCK).write.parquet(path)
    return {"blocks": path, "means": list(df.agg(*[F.avg(num(c)) for c in names]).first())}


@transform("impute_knn", fit=fit_knn, columns=REQUIRED, n_neighbors=5, weights="uniform")
def impute_knn(df, p, state):
    """The mean of the nearest of all train rows that have the value; distances skip missing entries and scale up for them.

    Train rows are blocks of a table in the shared folder. Each distinct row with a missing value
    meets every block once, and the k nearest of each are merged; the work is their product."""
    names = list(p["columns"])
    need_numeric(df, *names)
    spark, width, k = df.sparkSession, len(names), p["n_neighbors"]
    own = [f"c{i}" for i in range(width)]
    missing = F.lit(False)
    for c in own:
        missing = missing | F.col(c).isNull()
    asked = knn_blocks(knn_rows(df, names).where(missing).distinct(), width, ASKED_BLOCK).select(F.col("x").alias("asked"))
    train = spark.read.schema("n long, keys binary, x binary").parquet(state["blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, t, key in zip(*(batch.column(c) for c in ("asked", "x", "keys")), strict=True):
                wanted = np.frombuffer(q.as_py()).reshape(-1, width)
                rows, keys = np.frombuffer(t.as_py()).reshape(-1, width), np.frombuffer(key.as_py(), dtype=np.int64)
                have, zeroed = ~np.isnan(rows), np.nan_to_num(rows)
                out: list[tuple] = []
                for first in range(0, len(wanted), KNN_STEP):
                    some = wanted[first : first + KNN_STEP]
                    known, filled = ~np.isnan(some), np.nan_to_num(some)
                    # Distances of some rows to the whole block, column by column.
                    n, square = np.zeros((len(some), len(rows))), np.zeros((len(some), len(rows)))
                    for i in range(width):
                        both = known[:, i, None] & have[None, :, i]
                        n += both
                        square += np.where(both, (filled[:, i, None] - zeroed[None, :, i]) ** 2, 0)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        far = np.where(n > 0, np.sqrt(square * width / n), np.inf)
                    for q_, j in zip(*np.nonzero(~known), strict=True):
                        near = np.where(have[:, j], far[q_], np.inf)
                        usable = np.flatnonzero(np.isfinite(near))
                        if len(usable) > k:
                            usable = usable[near[usable] <= np.partition(near[usable], k - 1)[k - 1]]
                        usable = usable[np.lexsort((rows[usable, j], keys[usable], near[usable]))[:k]]
                        if len(usable):
                            out.append((some[q_], int(j), [{"far": a, "key": b, "value": c} for a, b, c in zip(near[usable].tolist(), keys[usable].tolist(), rows[usable, j].tolist(), strict=True)]))
                if out:
                    x = np.array([o[0] for o in out])
                    columns = [pa.array(x[:, i], from_pandas=True) for i in range(width)]
                    kinds = pa.list_(pa.struct([("far", pa.float64()), ("key", pa.int64()), ("value", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], kinds)], names=[*own, "j", "near"])

    schema = ", ".join([*(f"{c} double" for c in own), "j int, near array<struct<far:double, key:bigint, value:double>>"])
    best = asked.crossJoin(train).select("asked", "x", "keys").mapInArrow(run, schema)
    best = best.groupBy(*own, "j").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    exact = F.filter("near", lambda e: e["far"] == 0)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, e: s + f(e))
    plain = lambda a: total(a, lambda e: e["value"]) / F.size(a)
    value = plain(F.col("near"))
    if p["weights"] == "distance":
        value = F.when(F.size(exact) > 0, plain(exact)).otherwise(total(F.col("near"), lambda e: e["value"] / e["far"]) / total(F.col("near"), lambda e: 1 / e["far"]))
    fills = best.withColumn("value", value).groupBy(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(own)]).agg(*[F.max(F.when(F.col("j") == i, F.col("value"))).alias(f"__fill{i}") for i in range(width)])
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & num(c).eqNullSafe(F.col(f"__c{i}"))
    joined = df.join(fills, same, "left")
    filled_in = {c: F.coalesce(num(c), F.col(f"__fill{i}"), F.lit(state["means"][i]).cast("double")) for i, c in enumerate(names)}
    return with_values(joined, filled_in).drop(*[f"__c{i}" for i in range(width)], *[f"__fill{i}" for i in range(width)])


def regress(df, names, target, current):
    """Ridge-less least squares of target on the others, from one aggregate of cross products."""
    others = [c for c in names if c != target]
    xs = [F.lit(1.0)] + [current[c] for c in others]
    seen = df.where(num(target).isNotNull())
    facts = [F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    facts += [F.sum(xs[i] * num(target)).alias(f"b{i}") for i in range(len(xs))]
    row = seen.agg(*facts).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(xs))] for i in range(len(xs))])
    b = np.array([row[f"b{i}"] or 0.0 for i in range(len(xs))])
    weights, *_ = np.linalg.lstsq(a + 1e-9 * np.diag(np.diag(a)), b, rcond=None)
    return others, weights.tolist()


def chained(df, names, rounds, means):
    """{column: (others, weights)} after rounds of regressions."""
    current = {c: F.coalesce(num(c), F.lit(means[c])) for c in names}
    models: dict = {}
    for _ in range(rounds):
        # Each round's fills are a function of the round before: expressions stay of bounded size.
        new = {}
        for c in names:
            others, weights = regress(df, names, c, current)
            new[c] = (others, weights)
        if models and all(np.allclose(new[c][1], models[c][1], rtol=1e-4, atol=1e-8) for c in names):
            break
        models = new
        base = {c: F.coalesce(num(c), F.lit(means[c])) for c in names}
        current = {c: F.coalesce(num(c), predicted(models[c], base)) for c in names}
    return models


def predicted(model, values):
    others, weights = model
    out = F.lit(weights[0])
    for c, w in zip(others, weights[1:], strict=True):
        out = out + values[c] * w
    return out


def fit_iterative(df, p):
    need_numeric(df, *p["columns"])
    names = list(p["columns"])
    row = df.agg(*[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    means = {c: row[f"m{i}"] for i, c in enumerate(names)}
    if lacking := [c for c, m in means.items() if m is None]:
        raise EngineError(f"column {lacking[0]!r} has no value to learn from")
    return {"means": means, "models": {c: list(m) for c, m in chained(df, names, p["max_iter"], means).items()}}


@transform("impute_iterative", fit=fit_iterative, columns=REQUIRED, max_iter=10, random_state=0, streamable=True)
def impute_iterative(df, p, state):
    """Chained linear regressions fitted on train by aggregates; a missing entry is predicted twice over, first from means, then from first predictions."""
    names = list(p["columns"])
    need_numeric(df, *names)
    first = {c: F.coalesce(num(c), F.lit(state["means"][c])) for c in names}
    second = {c: F.coalesce(num(c), predicted(state["models"][c], first)) for c in names}
    return with_values(df, {c: F.coalesce(num(c), predicted(state["models"][c], second)) for c in names})


@transform("ffill", sort_by=REQUIRED, columns=None, by=None, limit=None)
def ffill(df, p, state):
    """The last value seen before, in order of sort_by, within by (a missing by is a group); at most limit rows on."""
    need(df, p["sort_by"], *([p["by"]] if p["by"] else []))
    names = p["columns"] or [c for c in df.columns if c not in (p["sort_by"], p["by"], "_rid")]
    need(df, *names)
    guard = F.when(col(p["sort_by"]).isNull(), F.raise_error(F.lit(f"ffill: {p['sort_by']} is missing")).cast("string"))
    part = W.partitionBy(*([col(p["by"])] if p["by"] else []))
    window = part.orderBy(col(p["sort_by"]), guard, *row_order(df))
    tagged = df.withColumn("__n", F.row_number().over(window))
    upto = part.orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for c in names:
        x = F.when(~F.isnan(col(c)), col(c)) if isinstance(kind(df, c), (T.DoubleType, T.FloatType)) else col(c)
        seen = F.last(F.when(x.isNotNull(), F.struct(F.col("__n").alias("n"), x.alias("v"))), ignorenulls=True).over(upto)
        near = F.col("__n") - seen["n"] <= p["limit"] if p["limit"] is not None else F.lit(True)
        out[c] = F.coalesce(x, F.when(near, seen["v"]))
    return with_values(tagged, out).drop("__n")
