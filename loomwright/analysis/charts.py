"""Aggregated data for charts, and figures as plain dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.errors import EngineError
from loomwright.operators.base import col, num

AGGREGATES = {"count": lambda y: F.count(F.lit(1)), "mean": F.avg, "sum": F.sum, "median": F.median, "min": F.min, "max": F.max}
KINDS = ("bar", "line", "area", "pie", "box", "violin", "histogram", "scatter", "density", "heatmap", "strip")
SAMPLE = 10_000


def aggregated(df: DataFrame, x: str, y: str | None = None, how: str = "count", color: str | None = None, facets=()) -> DataFrame:
    """(x, color, facets, value)."""
    if how not in AGGREGATES:
        raise EngineError(f"unknown aggregate {how!r}")
    keys = [col(c).alias(c) for c in dict.fromkeys([x, *([color] if color else []), *facets])]
    return df.groupBy(*keys).agg(AGGREGATES[how](num(y) if y else None).alias("value"))


def density(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """(bx, by, count) over a grid."""
    edges = df.agg(F.min(num(x)).alias("xa"), F.max(num(x)).alias("xb"), F.min(num(y)).alias("ya"), F.max(num(y)).alias("yb"))
    place = lambda v, a, b: F.when(F.col(b) > F.col(a), F.least(F.floor((v - F.col(a)) / ((F.col(b) - F.col(a)) / bins)), F.lit(bins - 1))).otherwise(0).cast("long")
    rows = df.select(num(x).alias("x"), num(y).alias("y")).dropna().crossJoin(F.broadcast(edges))  # edges is one row
    return rows.groupBy(place(F.col("x"), "xa", "xb").alias("bx"), place(F.col("y"), "ya", "yb").alias("by")).agg(F.count("*").alias("count"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r2) of the least-squares line."""
    return df.agg(F.regr_slope(num(y), num(x)).alias("slope"), F.regr_intercept(num(y), num(x)).alias("intercept"), F.regr_r2(num(y), num(x)).alias("r2"))


def points(df: DataFrame, x: str, y: str, key: str = "_rid", most: int = SAMPLE, seed: int = 0) -> DataFrame:
    """A seeded sample of points for drawing; the number drawn is the feature."""
    return df.select(col(x), col(y), F.xxhash64(F.lit(seed), col(key)).alias("__h")).orderBy("__h").limit(most).drop("__h")


def figure(kind: str, rows: list[dict], x: str, y: str = "value", color: str | None = None) -> dict:
    """A figure as data: traces by color."""
    if kind not in KINDS:
        raise EngineError(f"unknown chart {kind!r}")
    traces: dict = {}
    for r in rows:
        t = traces.setdefault(r.get(color) if color else None, {"type": kind, "name": r.get(color) if color else None, "x": [], "y": []})
        t["x"].append(r[x])
        t["y"].append(r[y])
    return {"data": list(traces.values()), "layout": {"xaxis": {"title": x}, "yaxis": {"title": y}}}
