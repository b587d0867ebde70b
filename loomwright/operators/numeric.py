"""Numeric transforms whose parameters are statistics of the train frame."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.errors import EngineError
from loomwright.functions.running import value_counts
from loomwright.operators.base import REQUIRED, col, need, need_numeric, no_clash, num, numeric_columns, one_row, transform, with_values

#: More new columns than this are refused unless the step says so.
MOST_COLUMNS = 100


def stats(df, names, **wanted):
    """{column: {statistic: value}} from one aggregate."""
    need_numeric(df, *names)
    found = one_row(df, *[make(num(c)).alias(f"{i}:{k}") for i, c in enumerate(names) for k, make in wanted.items()])
    return {c: {k: found[f"{i}:{k}"] for k in wanted} for i, c in enumerate(names)}


def percentile(x, *shares):
    return F.percentile(x, F.array(*[F.lit(float(s)) for s in shares]))


def complete(found):
    for name, values in found.items():
        if any(v is None for v in values.values()):
            raise EngineError(f"column {name!r} has no value to learn from")
    return found


def fit_clip(df, p):
    if p["lower"] > p["upper"]:
        raise EngineError("clip: lower is above upper")
    found = complete(stats(df, p["columns"], b=lambda x: percentile(x, p["lower"] / 100, p["upper"] / 100)))
    return {c: v["b"] for c, v in found.items()}


@transform("clip", fit=fit_clip, columns=REQUIRED, lower=1.0, upper=99.0, streamable=True)
def clip(df, p, state):
    """Percentile bounds of train (linear interpolation)."""
    need_numeric(df, *p["columns"])
    return with_values(df, {c: F.when(num(c) < state[c][0], state[c][0]).when(num(c) > state[c][1], state[c][1]).otherwise(num(c)) for c in p["columns"]})


def fit_scale(df, p):
    wanted = {
        "standard": {"center": F.avg, "scale": F.stddev_pop},
        "minmax": {"center": F.min, "top": F.max},
        "robust": {"q": lambda x: percentile(x, 0.25, 0.5, 0.75)},
        "maxabs": {"scale": lambda x: F.max(F.abs(x))},
    }[p["method"]]
    out = {}
    for c, v in complete(stats(df, p["columns"], **wanted)).items():
        center = v.get("center", 0.0)
        scale = v.get("scale")
        if p["method"] == "minmax":
            scale = v["top"] - v["center"]
        elif p["method"] == "robust":
            center, scale = v["q"][1], v["q"][2] - v["q"][0]
        out[c] = [float(center), float(scale) or 1.0]
    return out


@transform("scale", fit=fit_scale, columns=REQUIRED, method="standard", streamable=True)
def scale(df, p, state):
    """(x - center) / scale; a scale of 0 counts as 1."""
    need_numeric(df, *p["columns"])
    return with_values(df, {c: (num(c) - state[c][0]) / state[c][1] for c in p["columns"]})


@transform("log1p", columns=REQUIRED, streamable=True)
def log1p(df, p, state):
    """Negative values raise when the plan runs."""
    need_numeric(df, *p["columns"])
    guard = lambda c: F.when(num(c) < 0, F.raise_error(F.lit(f"column {c}: log1p of a negative value")).cast("double")).otherwise(num(c))
    return with_values(df, {c: F.log1p(guard(c)) for c in p["columns"]})


# -- alignment --------------------------------------------------------------------------------


#: Groups of a state at most, some 1 KB each.
MOST_GROUPS = 20_000
FACTS = "n long, mean double, std double, q array<double>, grid array<double>"


def location_facts(x, n_quantiles):
    return {
        "n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "q": percentile(x, 0.25, 0.5, 0.75),
        "grid": percentile(x, *np.linspace(0, 1, n_quantiles)),
    }


def fit_align(df, p):
    out = {}
    for c in p["columns"]:
        need_numeric(df, c)
        facts = location_facts(num(c), p["n_quantiles"] if p["mode"] == "quantile" else 2)
        out[c] = {"all": df.agg(*[v.alias(k) for k, v in facts.items()]).first().asDict()}
        if p["group"]:
            need(df, p["group"])
            groups = df.where(col(p["group"]).isNotNull()).groupBy(col(p["group"]).cast("string").alias("g")).agg(*[v.alias(k) for k, v in facts.items()])
            rows = groups.where(F.col("n") >= p["min_rows"]).limit(MOST_GROUPS + 1).collect()
            if len(rows) > MOST_GROUPS:
                raise EngineError(f"align_to_train: {p['group']!r} has over {MOST_GROUPS} groups")
            out[c]["groups"] = {r["g"]: {k: r[k] for k in facts} for r in rows}
    return out


def point_of(grid, share):
    """The value at a share (0 .. 1) of an array of points, linear between them."""
    place = share * (F.size(grid) - 1)
    low = F.least(F.floor(place), F.size(grid) - 2).cast("int")
    a, b = F.get(grid, low), F.get(grid, low + 1)
    return a + (place - low) * (b - a)


def aligned(x, mode, target, own):
    """x moved from its own frame's location (and spread, or ranks) to the target's: dicts of columns."""
    if mode == "shift_mean":
        value = x + (target["mean"] - own["mean"])
    elif mode == "shift_median":
        value = x + (target["q"][1] - own["q"][1])
    elif mode == "standardize":
        value = (x - own["mean"]) * F.when(own["std"] > 0, F.coalesce(target["std"], F.lit(0.0)) / own["std"]).otherwise(1.0) + target["mean"]
    elif mode == "robust":
        wide = own["q"][2] - own["q"][0]
        value = (x - own["q"][1]) * F.when(wide > 0, (target["q"][2] - target["q"][0]) / wide).otherwise(1.0) + target["q"][1]
    else:
        value = F.when(x.isNotNull(), point_of(target["grid"], F.when(own["n"] > 1, (own["rank"] - 1) / (own["n"] - 1)).otherwise(0.5)))
    return F.when(target["n"] > 0, value).otherwise(x)


def interpolated(x, xs, ys):
    """Piecewise linear through (xs, ys), flat outside; xs ascend."""
    out = F.lit(float(ys[-1]))
    for (a, b), (u, v) in reversed(list(zip(itertools.pairwise(xs), itertools.pairwise(ys), strict=True))):
        if b > a:
            out = F.when(x <= b, F.lit(float(u)) + (x - float(a)) * ((v - u) / (b - a))).otherwise(out)
    return F.when(x.isNull(), None).when(x <= float(xs[0]), F.lit(float(ys[0]))).otherwise(out)


@transform("align_to_train", fit=fit_align, columns=REQUIRED, mode="shift_mean", group=None, min_rows=30, on_small="skip", n_quantiles=100)
def align_to_train(df, p, state):
    """Move each frame's own location (and spread, or ranks) to train's; per group, small groups by the whole. Looks at the frame's rows."""
    if p["mode"] not in ("shift_mean", "shift_median", "standardize", "robust", "quantile"):
        raise EngineError(f"unknown mode {p['mode']!r}")
    out, ranked = df, p["mode"] == "quantile"
    constant = lambda facts: {k: F.lit(v).cast(t) if not isinstance(v, list) else F.array(*map(F.lit, v)) for (k, t), v in zip((f.split() for f in FACTS.split(", ")), facts, strict=True)}
    for c in p["columns"]:
        need_numeric(df, c)
        x = num(c)
        facts = location_facts(x, 2)
        whole = df.agg(*[v.alias(k) for k, v in facts.items()]).first()
        own = constant(whole)
        if ranked:
            # The mean rank of a value, from the values' places.
            places = value_counts(df, x, "__value").select("__value", (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2).alias("__rank"))
            out = out.join(places, x == F.col("__value"), "left").drop("__value")
            own["rank"] = F.col("__rank")
        value = aligned(x, p["mode"], constant([state[c]["all"][k] for k in facts]), own)
        if p["group"]:
            group = col(p["group"]).cast("string")
            learned = df.sparkSession.createDataFrame([(g, tuple(f[k] for k in facts)) for g, f in state[c]["groups"].items()], f"__g string, __target struct<{FACTS.replace(' ', ':').replace(',:', ',')}>")
            here = df.where(group.isNotNull()).groupBy(group.alias("__h")).agg(F.struct(*[v.alias(k) for k, v in facts.items()]).alias("__own"))
            out = out.join(F.broadcast(learned), group == F.col("__g"), "left").join(here, group == F.col("__h"), "left")  # learned: MOST_GROUPS rows at most
            mine = {k: F.col(f"__own.{k}") for k in facts}
            if ranked:
                counts = df.select(group.alias("__k"), x.alias("__value")).dropna().groupBy("__k", "__value").agg(F.count("*").alias("__n"))
                below = F.coalesce(F.sum("__n").over(W.partitionBy("__k").orderBy("__value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
                counts = counts.select("__k", "__value", (below + (F.col("__n") + 1) / 2).alias("__place"))
                out = out.join(counts, (group == F.col("__k")) & (x == F.col("__value")), "left")
                mine["rank"] = F.col("__place")
            small = F.raise_error(F.lit(f"column {c}: a group has too few rows")).cast("double") if p["on_small"] == "raise" else value
            enough = F.col("__target").isNotNull() & (mine["n"] >= p["min_rows"])
            value = F.when(enough, aligned(x, p["mode"], {k: F.col(f"__target.{k}") for k in facts}, mine)).otherwise(small)
        out = with_values(out, {c: value}).drop("__rank", "__g", "__target", "__h", "__own", "__k", "__value", "__place")
    return out


# -- shapes -----------------------------------------------------------------------------------


def yeo_johnson(x, lam):
    up = F.log1p(x) if abs(lam) < 1e-8 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-8 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def box_cox(x, lam):
    return F.log(x) if abs(lam) < 1e-8 else (F.pow(x, F.lit(lam)) - 1) / lam


def best_lambda(df, name, method):
    """The lambda of most likelihood: a grid in one aggregate, refined four times."""
    shape = yeo_johnson if method == "yeo-johnson" else box_cox
    x = num(name)
    slope = F.sum(F.signum(x) * F.log1p(F.abs(x))) if method == "yeo-johnson" else F.sum(F.log(x))
    low, high = -3.0, 5.0
    best = 1.0
    for _ in range(5):
        grid = np.linspace(low, high, 17)
        row = df.agg(F.count(x).alias("n"), slope.alias("s"), *[F.var_pop(shape(x, float(g))).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        if not row["n"]:
            raise EngineError(f"column {name!r} has no value to learn from")
        gain = [-row["n"] / 2 * math.log(row[f"v{i}"]) + (g - 1) * row["s"] if row[f"v{i}"] and math.isfinite(row[f"v{i}"]) else -math.inf for i, g in enumerate(grid)]
        best = float(grid[int(np.argmax(gain))])
        step = grid[1] - grid[0]
        low, high = best - step, best + step
    return best


def fit_power(df, p):
    need_numeric(df, *p["columns"])
    out = {}
    for c in p["columns"]:
        if p["method"] == "box-cox" and (one_row(df, F.min(num(c)).alias("m"))["m"] or 1) <= 0:
            raise EngineError(f"column {c!r}: box-cox needs positive values")
        lam = best_lambda(df, c, p["method"])
        y = (yeo_johnson if p["method"] == "yeo-johnson" else box_cox)(num(c), lam)
        row = one_row(df, F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
        out[c] = [lam, row["mean"] or 0.0, row["std"] or 1.0]
    return out


@transform("power_transform", fit=fit_power, columns=REQUIRED, method="yeo-johnson", standardize=True, streamable=True)
def power_transform(df, p, state):
    """Yeo-Johnson or Box-Cox. lambda is found on grids, to some 1e-4 of the best."""
    shape = yeo_johnson if p["method"] == "yeo-johnson" else box_cox
    out = {}
    for c in p["columns"]:
        lam, mean, std = state[c]
        y = shape(num(c), lam)
        out[c] = (y - mean) / std if p["standardize"] else y
    return with_values(df, out)


def fit_quantile(df, p):
    n = p["n_quantiles"]
    found = complete(stats(df, p["columns"], n=F.count, q=lambda x: percentile(x, *np.linspace(0, 1, n))))
    return {c: v["q"] for c, v in found.items()}


def normal_quantile(u):
    """The inverse normal distribution (rational approximation, error under 5e-4 of a standard deviation)."""
    tail = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    top = 2.515517 + tail * (0.802853 + tail * 0.010328)
    below = 1 + tail * (1.432788 + tail * (0.189269 + tail * 0.001308))
    size = tail - top / below
    return F.when(u < 0.5, -size).otherwise(size)


@transform("quantile_transform", fit=fit_quantile, columns=REQUIRED, output_distribution="uniform", n_quantiles=100, random_state=0, streamable=True)
def quantile_transform(df, p, state):
    """Shares by train's quantiles: the mean of the two one-sided interpolations, so that ties land in the middle."""
    out = {}
    for c in p["columns"]:
        q = state[c]
        refs = np.linspace(0, 1, len(q)).tolist()
        x = num(c)
        up = stepped(x, q, refs)
        down = 1 - stepped(-x, [-v for v in q[::-1]], refs)
        share = F.when(x.isNotNull(), F.least(F.greatest((up + down) / 2, F.lit(0.0)), F.lit(1.0)))
        if p["output_distribution"] == "normal":
            share = normal_quantile(F.least(F.greatest(share, F.lit(1e-7)), F.lit(1 - 1e-7)))
        out[c] = share
    return with_values(df, out)


def stepped(x, xs, ys):
    """Interpolation with repeated xs: the last of equal points counts."""
    points = {}
    for a, b in zip(xs, ys, strict=True):
        points[a] = b
    return interpolated(x, list(points), list(points.values()))


def basis_names(column, n):
    return [f"{column}_sp{k}" for k in range(n)]


def fit_spline(df, p):
    out = {}
    for c in p["columns"]:
        need_numeric(df, c)
        if p["knots"] == "quantile":
            knots = complete(stats(df, [c], q=lambda x: percentile(x, *np.linspace(0, 1, p["n_knots"]))))[c]["q"]
            knots = sorted(set(knots))
        else:
            v = complete(stats(df, [c], a=F.min, b=F.max))[c]
            knots = np.linspace(v["a"], v["b"], p["n_knots"]).tolist()
        if len(set(knots)) < 2:
            raise EngineError(f"column {c!r} has too few values for a spline")
        d = p["degree"]
        low, high = knots[1] - knots[0], knots[-1] - knots[-2]
        out[c] = [knots[0] - low * k for k in range(d, 0, -1)] + knots + [knots[-1] + high * k for k in range(1, d + 1)]
    return out


def bases(x, knots, degree):
    """B-spline bases at x held within the base interval (Cox - de Boor)."""
    first, last = knots[degree], knots[-degree - 1]
    x = F.least(F.greatest(x, F.lit(first)), F.lit(last))
    final = len(knots) - degree - 2
    inside = lambda i: (x >= knots[i]) & ((x <= knots[i + 1]) if i == final else (x < knots[i + 1]))
    level = [F.when(inside(i), 1.0).otherwise(0.0) if i <= final else F.lit(0.0) for i in range(len(knots) - 1)]
    for d in range(1, degree + 1):
        level = [
            (x - knots[i]) / (knots[i + d] - knots[i]) * level[i] + (knots[i + d + 1] - x) / (knots[i + d + 1] - knots[i + 1]) * level[i + 1]
            for i in range(len(level) - 1)
        ]
    return level


@transform("spline", fit=fit_spline, columns=REQUIRED, n_knots=5, degree=3, knots="uniform", include_bias=True, max_output_columns=MOST_COLUMNS, streamable=True)
def spline(df, p, state):
    """Each column gives way to its bases; constant outside train's range; a missing value has none."""
    new, total = {}, 0
    for c in p["columns"]:
        x = num(c)
        found = bases(x, state[c], p["degree"])
        found = found if p["include_bias"] else found[:-1]
        total += len(found)
        new |= {n: F.when(x.isNotNull(), b) for n, b in zip(basis_names(c, len(found)), found, strict=True)}
    if total > p["max_output_columns"]:
        raise EngineError(f"spline would make {total} columns")
    no_clash(df, *new)
    return with_values(df, new).drop(*p["columns"])


def product(names):
    out = num(names[0])
    for n in names[1:]:
        out = out * num(n)
    return out


def term_name(names):
    return "*".join(n if names.count(n) == 1 else f"{n}^{names.count(n)}" for n in dict.fromkeys(names))


@transform("polynomial", columns=REQUIRED, degree=2, interaction_only=False, include_bias=False, max_output_columns=MOST_COLUMNS, streamable=True)
def polynomial(df, p, state):
    """All products up to a degree, in place of the columns."""
    need_numeric(df, *p["columns"])
    pick = itertools.combinations if p["interaction_only"] else itertools.combinations_with_replacement
    terms = [t for d in range(1, p["degree"] + 1) for t in pick(p["columns"], d)]
    if len(terms) + p["include_bias"] > p["max_output_columns"]:
        raise EngineError(f"polynomial would make {len(terms)} columns")
    new = ([F.lit(1.0).alias("1")] if p["include_bias"] else []) + [product(list(t)).alias(term_name(list(t))) for t in terms]
    at = min(df.columns.index(c) for c in p["columns"])
    rest = [c for c in df.columns if c not in p["columns"]]
    before = sum(df.columns.index(c) < at for c in rest)
    return df.select(*[col(c) for c in rest[:before]], *new, *[col(c) for c in rest[before:]])


@transform("interactions", columns=REQUIRED, interaction_only=True, streamable=True)
def interactions(df, p, state):
    """Products of every two columns (squares too unless interaction_only), as new columns."""
    if len(p["columns"]) > 10:
        raise EngineError("interactions takes 10 columns at most")
    need_numeric(df, *p["columns"])
    pick = itertools.combinations if p["interaction_only"] else itertools.combinations_with_replacement
    new = {f"{a}*{b}": num(a) * num(b) for a, b in pick(p["columns"], 2)}
    no_clash(df, *new)
    return with_values(df, new)


def fit_pca(df, p):
    names = p["columns"] or numeric_columns(df, p["target"])
    need_numeric(df, *names)
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in names))
    k = len(names)
    facts = [F.count("*").alias("n")] + [F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(names)]
    facts += [F.covar_samp(num(names[i]), num(names[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    row = whole.agg(*facts).first()
    if row["n"] < 2:
        raise EngineError("pca needs two complete rows")
    mean = np.array([row[f"m{i}"] for i in range(k)])
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n = row["n"]
    std = np.sqrt(np.diag(cov) * (n - 1) / n) if p["standardize"] else np.ones(k)
    std[std == 0] = 1.0
    cov = cov / np.outer(std, std)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)
    value, vector = np.maximum(value[order], 0), vector[:, order].T
    signs = np.sign(vector[np.arange(k), np.abs(vector).argmax(axis=1)])
    vector *= signs[:, None]
    share = value / value.sum() if value.sum() else np.zeros(k)
    wanted = p["n_components"]
    count = int(np.searchsorted(np.cumsum(share), wanted - 1e-12) + 1) if isinstance(wanted, float) and wanted < 1 else int(wanted)
    if count > k:
        raise EngineError(f"pca has {k} components at most")
    return {"columns": names, "mean": mean.tolist(), "std": std.tolist(), "vectors": vector[:count].tolist(), "values": value[:count].tolist(), "shares": share[:count].tolist()}


@transform("pca", fit=fit_pca, n_components=2, columns=None, standardize=True, whiten=False, target=None, prefix="pc", streamable=True)
def pca(df, p, state):
    """Principal components in place of the columns; each vector's largest entry is positive."""
    need_numeric(df, *state["columns"])
    centered = [(num(c) - m) / s for c, m, s in zip(state["columns"], state["mean"], state["std"], strict=True)]
    new = {}
    for k, vector in enumerate(state["vectors"]):
        total = F.lit(0.0)
        for weight, x in zip(vector, centered, strict=True):
            total = total + x * weight
        new[f"{p['prefix']}{k + 1}"] = total / math.sqrt(state["values"][k]) if p["whiten"] and state["values"][k] > 0 else total
    return with_values(df, new).drop(*state["columns"])
