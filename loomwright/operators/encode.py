"""Categories as numbers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError
from loomwright.operators.base import NUMERIC, REQUIRED, col, kind, need, no_clash, transform, with_values

#: A vocabulary in a state, and so a frame's new columns, has at most so many values.
MOST_VALUES = 1000


def label(df, name):
    """A value as text: whole doubles without a fraction."""
    x = col(name)
    if isinstance(kind(df, name), (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(x), None).when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    return x.cast("string")


def fit_onehot(df, p):
    need(df, *p["columns"])
    out = {}
    for name in p["columns"]:
        counts = df.where(label(df, name).isNotNull()).groupBy(label(df, name).alias("v")).count()
        total = counts.agg(F.sum("count")).first()[0] or 0
        least = p["min_frequency"]
        least = 0 if least is None else math.ceil(least * total) if isinstance(least, float) else least
        kept = counts.where(F.col("count") >= least).orderBy("v").limit(MOST_VALUES + 1).collect()
        if len(kept) > MOST_VALUES:
            raise EngineError(f"onehot: column {name!r} has over {MOST_VALUES} values; set min_frequency")
        rare = counts.where(F.col("count") < least).limit(1).count() > 0
        out[name] = {"values": [r["v"] for r in kept], "rare": rare}
    return out


@transform("onehot", fit=fit_onehot, columns=REQUIRED, min_frequency=None, drop_first=False, handle_unknown="ignore", missing=False, streamable=True)
def onehot(df, p, state):
    """0 / 1 columns for train's values, in place; rare values share one. An unknown value is all zeros (or rare, if train had rare ones), or an error."""
    need(df, *p["columns"])
    out = []
    for c in df.columns:
        if c not in p["columns"]:
            out.append(col(c))
            continue
        known, x = state[c], label(df, c)
        inside = x.isin(known["values"]) if known["values"] else F.lit(False)
        if p["handle_unknown"] == "error" and not known["rare"]:
            x = F.when(x.isNotNull() & ~inside, F.raise_error(F.concat(F.lit(f"onehot: column {c}: unknown value "), x)).cast("string")).otherwise(x)
        made = [(f"{c}_{v}", F.coalesce((x == v).cast("int"), F.lit(0))) for v in known["values"]]
        if known["rare"]:
            made.append((f"{c}_infrequent", F.coalesce((x.isNotNull() & ~inside).cast("int"), F.lit(0))))
        made = made[1:] if p["drop_first"] else made
        if p["missing"]:
            made.append((f"{c}_missing", x.isNull().cast("int")))
        no_clash(df.drop(*p["columns"]), *[n for n, _ in made])
        out += [v.alias(n) for n, v in made]
    return df.select(*out)


@transform("ordinal", categories=REQUIRED, streamable=True)
def ordinal(df, p, state):
    """Places in a given order; an unknown value is -1, a missing one stays missing."""
    need(df, *p["categories"])
    out = {}
    for name, order in p["categories"].items():
        x = col(name) if isinstance(kind(df, name), NUMERIC) else col(name).cast("string")
        chain = F.when(x.isNull(), F.lit(None).cast("long"))
        for k, value in enumerate(order):
            chain = chain.when(x == F.lit(value), F.lit(k).cast("long"))
        out[name] = chain.otherwise(F.lit(-1).cast("long"))
    return with_values(df, out)
