"""Filters, order, samples and duplicates of rows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError
from loomwright.operators.base import RID, REQUIRED, col, kind, need, one_row, row_order, same_kind, transform

#: Lists of up to so many values are a predicate; longer ones a join with a table of the values.
LONG_LIST = 10_000


def condition(df, c: dict):
    """A predicate that is never NULL: ne and notin hold on a missing value, all others but isna don't."""
    name, op, value = c["column"], c["op"], c.get("value")
    need(df, name)
    x, dtype = col(name), kind(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        x = F.when(~F.isnan(x), x)
    if op == "isna":
        return x.isNull()
    if op == "notna":
        return x.isNotNull()
    if op in ("isin", "notin"):
        if not isinstance(value, (list, tuple)):
            raise EngineError(f"{op} needs a list")
        fit = [v for v in value if same_kind(dtype, v)]
        inside = F.coalesce(x.isin(fit), F.lit(False)) if fit else F.lit(False)
        return inside if op == "isin" else ~inside
    if value is None:
        raise EngineError(f"{op} needs a value")
    if op in ("eq", "ne"):
        equal = F.coalesce(x == F.lit(value), F.lit(False)) if same_kind(dtype, value) else F.lit(False)
        return equal if op == "eq" else ~equal
    if not same_kind(dtype, value):
        raise EngineError(f"column {name!r} can't be compared with {value!r}")
    right = F.lit(value).cast(dtype) if not isinstance(dtype, (T.StringType, *_numeric())) else F.lit(value)
    found = {"gt": x > right, "ge": x >= right, "lt": x < right, "le": x <= right}
    if op not in found:
        raise EngineError(f"unknown condition {op!r}")
    return F.coalesce(found[op], F.lit(False))


def _numeric():
    from loomwright.operators.base import NUMERIC

    return NUMERIC


@transform("filter_rows", conditions=REQUIRED, combine="and", streamable=True)
def filter_rows(df, p, state):
    if not p["conditions"]:
        raise EngineError("filter_rows needs a condition")
    return df.where(reduce(and_ if p["combine"] == "and" else or_, [condition(df, c) for c in p["conditions"]]))


def directions(by, ascending) -> list[bool]:
    out = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(out) != len(by):
        raise EngineError("ascending must give one value for each column")
    return out


def sort_keys(df, by, ascending=True, na_position="last"):
    need(df, *by)
    keys = []
    for name, up in zip(by, directions(by, ascending), strict=True):
        x = col(name)
        if isinstance(kind(df, name), (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        way = ("asc" if up else "desc") + "_nulls_" + na_position
        keys.append(getattr(x, way)())
    return keys


@transform("sort_rows", by=REQUIRED, ascending=True, na_position="last")
def sort_rows(df, p, state):
    """Missing values stand at na_position whichever the direction; ties stay in the frame's order."""
    return df.orderBy(*sort_keys(df, p["by"], p["ascending"], p["na_position"]), *row_order(df))


@transform("sample_rows", mode="random", n=None, frac=None, random_state=None)
def sample_rows(df, p, state):
    """The first rows, or a seeded draw without replacement; the order stays. Needs _rid.

    The draw depends on the number of rows and the seed alone. Rows carry a random key that is a
    function of (seed, _rid); the k least keys are drawn, so nothing but k is known to the driver."""
    if (p["n"] is None) == (p["frac"] is None):
        raise EngineError("sample_rows takes n or frac")
    need(df, RID)
    k = p["n"] if p["n"] is not None else round(df.count() * p["frac"])
    if p["mode"] == "head":
        return df.orderBy(RID).limit(k)
    if p["random_state"] is None:
        raise EngineError("a random sample needs random_state")
    seed = int(np.random.default_rng(p["random_state"]).integers(2**62))
    key = F.xxhash64(F.lit(seed), F.col(RID))
    return df.withColumn("__key", key).orderBy("__key", RID).limit(k).drop("__key").orderBy(RID)


@transform("drop_duplicates", subset=None, keep="first", sort_by=None)
def drop_duplicates(df, p, state):
    """One row of each group of equal subset values (missing equals missing): the first or last by sort_by, or none of the repeated."""
    subset = p["subset"] or [c for c in df.columns if c != RID]
    need(df, *subset)
    group = W.partitionBy(*[col(c) for c in subset])
    if p["keep"] == "none":
        return df.withColumn("__n", F.count("*").over(group)).where("__n = 1").drop("__n")
    if not p["sort_by"]:
        raise EngineError("keep first or last needs sort_by")
    need(df, *p["sort_by"])
    first = p["keep"] == "first"
    keys = [col(c).asc_nulls_last() if first else col(c).desc_nulls_first() for c in p["sort_by"]]
    keys += [k.asc() if first else k.desc() for k in row_order(df)]
    out = df.withColumn("__n", F.row_number().over(group.orderBy(*keys))).where("__n = 1").drop("__n")
    return out


def fit_target(df, p):
    return {"missing": one_row(df, F.count_if(col(p["target"]).isNull()).alias("n"))["n"]} if p["target"] in df.columns else {}


@transform("drop_missing_target", fit=fit_target, target=REQUIRED, streamable=True)
def drop_missing_target(df, p, state):
    return df.where(col(p["target"]).isNotNull()) if p["target"] in df.columns else df


def fit_high_missing(df, p):
    keep = {RID, p["target"], *(p["exclude"] or ())}
    names = [c for c in df.columns if c not in keep]
    found = one_row(df, *[F.avg(col(c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(names)])
    return {"dropped": [c for i, c in enumerate(names) if (found[f"c{i}"] or 0) > p["threshold"]]}


@transform("drop_high_missing", fit=fit_high_missing, threshold=0.5, exclude=None, target=None, streamable=True)
def drop_high_missing(df, p, state):
    return df.drop(*[c for c in state["dropped"] if c in df.columns])
