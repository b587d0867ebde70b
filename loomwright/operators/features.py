"""New columns from others."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError
from loomwright.functions.formula import compile_formula, variables_of
from loomwright.operators.base import REQUIRED, col, kind, need, need_numeric, no_clash, num, row_order, transform, with_values
from loomwright.operators.numeric import complete, percentile, stats
from loomwright.session import bounded_broadcast

MOST_GROUPS = 200_000


def as_time(df, name):
    """A timestamp, NULL where the text is none."""
    if isinstance(kind(df, name), T.StringType):
        return F.expr(f"try_cast(`{name}` AS timestamp_ntz)")
    return col(name).cast("timestamp_ntz")


def micros(x):
    return F.unix_micros(x.cast("timestamp"))


@transform("derive", a=REQUIRED, b=REQUIRED, op=REQUIRED, name=None, min_denominator=1e-9, streamable=True)
def derive(df, p, state):
    """ratio (the divisor's size is at least min_denominator, its sign kept), difference, product or days_between (a - b)."""
    need(df, p["a"], p["b"])
    name = p["name"] or f"{p['a']}_{p['op']}_{p['b']}"
    if p["op"] == "days_between":
        value = (micros(as_time(df, p["a"])) - micros(as_time(df, p["b"]))) / 86_400_000_000.0
    else:
        need_numeric(df, p["a"], p["b"])
        a, b, least = num(p["a"]), num(p["b"]), float(p["min_denominator"])
        safe = F.when(F.abs(b) >= least, b).when(b < 0, F.lit(-least)).when(b.isNotNull(), F.lit(least))
        value = {"ratio": lambda: a / safe, "difference": lambda: a - b, "product": lambda: a * b}[p["op"]]()
    no_clash(df, name)
    return with_values(df, {name: value})


PARTS = {"hour": F.hour, "dayofweek": F.weekday, "month": F.month, "year": F.year, "is_weekend": lambda x: (F.weekday(x) >= 5).cast("int")}


@transform("datetime_parts", column=REQUIRED, parts=("hour", "dayofweek", "month", "year", "is_weekend"), streamable=True)
def datetime_parts(df, p, state):
    """dayofweek counts from Monday, 0."""
    need(df, p["column"])
    x = as_time(df, p["column"])
    new = {f"{p['column']}_{part}": PARTS[part](x).cast("long") for part in p["parts"]}
    no_clash(df, *new)
    return with_values(df, new)


@transform("cyclical", column=REQUIRED, period=REQUIRED, streamable=True)
def cyclical(df, p, state):
    need_numeric(df, p["column"])
    angle = num(p["column"]) * (2 * math.pi / p["period"])
    return with_values(df, {f"{p['column']}_sin": F.sin(angle), f"{p['column']}_cos": F.cos(angle)})


def fit_bin(df, p):
    if p["mode"] == "cut":
        edges = [float(e) for e in p["edges"] or ()]
        if len(edges) < 2 or sorted(set(edges)) != edges:
            raise EngineError("bin: edges must ascend")
    else:
        if not p["q"]:
            raise EngineError("bin: qcut needs q")
        found = complete(stats(df, [p["column"]], q=lambda x: percentile(x, *[k / p["q"] for k in range(p["q"] + 1)])))
        inner = sorted(set(found[p["column"]]["q"]))[1:-1]
        edges = [-math.inf, *inner, math.inf]
    if p["labels"] and len(p["labels"]) != len(edges) - 1:
        raise EngineError(f"bin: {len(edges) - 1} labels are needed")
    return {"edges": [None if math.isinf(e) else e for e in edges]}


@transform("bin", fit=fit_bin, column=REQUIRED, mode="cut", edges=None, q=None, labels=None, name=None, streamable=True)
def bin_(df, p, state):
    """Intervals open on the left and closed on the right; outside them, missing. Integer codes, or labels."""
    need_numeric(df, p["column"])
    x, edges, out = num(p["column"]), state["edges"], None
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        hit = x.isNotNull()
        hit = hit & (x > low) if low is not None else hit
        hit = hit & (x <= high) if high is not None else hit
        value = F.lit(p["labels"][k]) if p["labels"] else F.lit(k).cast("long")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    name = p["name"] or f"{p['column']}_bin"
    no_clash(df, name)
    return with_values(df, {name: out})


def group_aggregate(df, name, value, order):
    x = num(value) if name not in ("first", "last", "count") else col(value)
    if name in ("first", "last"):
        need(df, order)
        key = F.struct(col(order), *row_order(df))
        use = col(value).isNotNull() & col(order).isNotNull()
        pick = F.min_by if name == "first" else F.max_by
        return pick(F.when(use, col(value)), F.when(use, key))
    return {"mean": F.avg, "std": F.stddev_samp, "count": F.count, "median": F.median, "min": F.min, "max": F.max}[name](x)


def fit_group(df, p):
    need(df, p["group"], p["value"])
    if p["target"] and p["target"] in (p["value"], p["group"]):
        raise EngineError("group_agg would leak the target")
    rows = df.where(col(p["group"]).isNotNull()).groupBy(col(p["group"]).alias("g")).agg(*[group_aggregate(df, a, p["value"], p["order"]).alias(a) for a in p["aggs"]])
    found = rows.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise EngineError(f"group_agg keeps {MOST_GROUPS} groups in its state at most; use group_table() and join_groups()")
    return {"groups": [[r["g"], *(r[a] for a in p["aggs"])] for r in found], "types": [f.dataType.simpleString() for f in rows.schema]}


def group_table(df, group, value, aggs, order=None):
    """The statistics as a distributed table, for groups beyond what a state may hold."""
    return df.where(col(group).isNotNull()).groupBy(group).agg(*[group_aggregate(df, a, value, order).alias(f"{value}_{a}_by_{group}") for a in aggs])


def join_groups(df, table, group):
    return df.join(bounded_broadcast(table, MOST_GROUPS), group, "left").select(*df.columns, *[c for c in table.columns if c != group])


@transform("group_agg", fit=fit_group, group=REQUIRED, value=REQUIRED, aggs=("mean",), order=None, target=None, streamable=True)
def group_agg(df, p, state):
    """Train's statistics of each group, looked up; a group that train hasn't is missing."""
    need(df, p["group"])
    names = [f"{p['value']}_{a}_by_{p['group']}" for a in p["aggs"]]
    no_clash(df, *names)
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(["__g", *names], state["types"], strict=True))
    table = df.sparkSession.createDataFrame([tuple(r) for r in state["groups"]], schema)
    return df.join(F.broadcast(table), col(p["group"]) == F.col("__g"), "left").drop("__g")


def fit_formula(df, p):
    return {"variables": variables_of(df, p["variables"])}


@transform("formula", fit=fit_formula, name=REQUIRED, expr=REQUIRED, variables=())
def formula(df, p, state):
    return with_values(df, {p["name"]: compile_formula(p["expr"], df, state.get("variables", {}))})
