"""Correlations, distributions, association with a target, and train / test comparison."""

from __future__ import annotations

import difflib
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.analysis.profile import MISSING_LABEL, names_of, of_columns, quantile, quantiles, with_total
from loomwright.functions.running import running
from loomwright.operators.base import INTEGRAL, NUMERIC, col, is_numeric, num, one_row
from loomwright.operators.select import binned, bins_of, coded, f_scores, mutual_information
from loomwright.session import written

# Fixed values of the comparison.
PSI_EPSILON = 1e-4
PSI_BINS = 10
PSI_LEVELS = (0.1, 0.25)
SMD_LEVEL, KS_LEVEL, TVD_LEVEL = 0.5, 0.2, 0.2
OUTSIDE_LEVELS = (3.0, 5.0)
OTHER = "(other)"
#: Distinct value pairs that one task compares for Kendall's tau.
KENDALL_BLOCK = 1_000_000


# -- correlation ------------------------------------------------------------------------------


def pearson(df: DataFrame, names) -> DataFrame:
    """(a, b, corr) of every two columns, rows where both are known; one aggregate."""
    pairs = list(itertools.combinations(names, 2))
    row = one_row(df, *[F.corr(num(a), num(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return df.sparkSession.createDataFrame([(a, b, _finite(row[f"r{k}"])) for k, (a, b) in enumerate(pairs)], "a string, b string, corr double")


def _finite(x):
    return None if x is None or math.isnan(x) else float(x)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(corr): Pearson's of average ranks over rows where both are known. Ranks come from value counts added up by ranges, so no task holds all values."""
    rows = df.select(num(a).alias("x"), num(b).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n"))

    def ranks(name):
        counts = running(rows.groupBy(name).agg(F.sum("n").alias("n")), [name], ["n"])
        return counts.select(F.col(name).alias(f"k{name}"), (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{name}"))

    joined = rows.join(ranks("x"), F.col("x") == F.col("kx")).join(ranks("y"), F.col("y") == F.col("ky"))
    # Pearson's of the ranks, weighted by the pairs' counts; the mean rank is the same on both sides.
    middle = (joined.agg(F.sum("n").alias("n")).first()["n"] or 0) / 2 + 0.5
    u, v, n = F.col("rx") - middle, F.col("ry") - middle, F.col("n")
    sums = joined.agg(F.sum(n * u * v).alias("uv"), F.sum(n * u * u).alias("uu"), F.sum(n * v * v).alias("vv"))
    return sums.select(F.when((F.col("uu") > 0) & (F.col("vv") > 0), F.col("uv") / F.sqrt(F.col("uu") * F.col("vv"))).alias("corr"))


def discordance(place, weight) -> float:
    """Sum of the products of weights over pairs of which the earlier has the larger place; places are distinct. Bit by bit from the top, as in a wavelet tree."""
    import numpy as np

    place, weight = np.unique(place, return_inverse=True)[1].astype(np.int64), np.asarray(weight, dtype=np.float64)
    total, at = 0.0, np.arange(len(place))
    for bit in range(max(0, int(place.max(initial=0)).bit_length() - 1), -1, -1):
        one = (place >> bit & 1).astype(bool)
        group = place >> (bit + 1)
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, at, 0))
        heavier = np.concatenate([[0.0], np.cumsum(np.where(one, weight, 0.0))])
        total += float((weight * (heavier[at] - heavier[start]))[~one].sum())
        # Within each group those with a 0 go first, in their order.
        zeros = np.concatenate([[0], np.cumsum(~one)])
        size = np.append(np.flatnonzero(first)[1:], len(place))[np.cumsum(first) - 1] if len(group) else start
        to = np.where(one, start + (zeros[size] - zeros[start]) + (at - start - (zeros[at] - zeros[start])), start + zeros[at] - zeros[start])
        moved, heavy = np.empty_like(place), np.empty_like(weight)
        moved[to], heavy[to] = place, weight
        place, weight = moved, heavy
    return total


def kendall(df: DataFrame, a: str, b: str, block: int = KENDALL_BLOCK) -> float | None:
    """Tau-b from the counts of distinct value pairs.

    Every pair of values gets its place by (x, y) and by (y, x); a pair of them is discordant where the
    two orders disagree. Places are cut into blocks. Pairs in different blocks of both orders are
    counted from the blocks' common weights, the others within each block, by one task a block."""
    rows = written(df.select(num(a).alias("x"), num(b).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n")), "pairs")
    half = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    whole = rows.agg(F.sum("n").alias("n"), half("n").alias("both"), F.count("*").alias("kinds")).first()
    if not whole["n"]:
        return None
    tied = {k: rows.groupBy(k).agg(F.sum("n").alias("n")).agg(half("n").alias("t")).first()["t"] for k in ("x", "y")}
    pairs = whole["n"] * (whole["n"] - 1) / 2
    if pairs == tied["x"] or pairs == tied["y"]:
        return None
    one = running(rows.withColumn("px", F.lit(1).cast("long")), ["x", "y"], ["px"]).select("x", "y", "n", (F.col("px_upto") - 1).alias("px"))
    both = running(one.withColumn("py", F.lit(1).cast("long")), ["y", "x"], ["py"]).select("n", "px", (F.col("py_upto") - 1).alias("py"))
    placed = written(both.withColumn("bx", (F.col("px") / block).cast("long")).withColumn("by", (F.col("py") / block).cast("long")), "places")

    def inside(own: str):
        def solve(part):
            import pandas as pd

            part = part.sort_values("px")
            found = discordance(part["py"].to_numpy(), part["n"].to_numpy())
            if own == "by":  # those of one block of the other order are counted there
                found -= sum(discordance(g["py"].to_numpy(), g["n"].to_numpy()) for _, g in part.groupby("bx"))
            return pd.DataFrame({"d": [found]})

        return placed.groupBy(own).applyInPandas(solve, "d double").agg(F.sum("d").alias("d")).first()["d"] or 0.0

    import numpy as np

    blocks = -(-whole["kinds"] // block)
    apart = 0.0
    if blocks > 1:
        table = np.zeros((blocks, blocks))
        for r in placed.groupBy("bx", "by").agg(F.sum("n").alias("n")).collect():  # the square of the number of blocks
            table[r["bx"], r["by"]] = r["n"]
        # Of block (i, j): all weights of later i and earlier j.
        later = np.zeros((blocks + 1, blocks + 1))
        later[:-1, 1:] = np.cumsum(np.cumsum(table[::-1], axis=0)[::-1], axis=1)
        apart = float((table * later[1:, :-1]).sum())
    discordant = apart + inside("bx") + (inside("by") if blocks > 1 else 0.0)
    s = pairs - tied["x"] - tied["y"] + whole["both"] - 2 * discordant
    return float(s / math.sqrt((pairs - tied["x"]) * (pairs - tied["y"])))


def correlated_pairs(df: DataFrame, names, least: float, target: str | None = None) -> DataFrame:
    """Pairs of |corr| >= least; keep: the one closer to the target, else the first."""
    found = pearson(df, names).where(F.abs("corr") >= least)
    if target is None:
        return found.withColumn("keep", F.col("a"))
    y = coded(df, target)
    row = one_row(df, *[F.abs(F.corr(num(c), y)).alias(f"t{i}") for i, c in enumerate(names)])
    strength = df.sparkSession.createDataFrame([(c, _finite(row[f"t{i}"]) or 0.0) for i, c in enumerate(names)], "c string, t double")
    left, right = (F.broadcast(strength.select(F.col("c").alias(f"c{s}"), F.col("t").alias(f"t{s}"))) for s in "ab")
    joined = found.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb"))
    return joined.select("a", "b", "corr", F.when(F.col("tb") > F.col("ta"), F.col("b")).otherwise(F.col("a")).alias("keep"))


# -- distributions ----------------------------------------------------------------------------


def numeric_distribution(df: DataFrame, name: str, by: str, edges: list[float]) -> DataFrame:
    """(group, bin, count, share, cumulative) over shared edges, the last bin closed; empty bins are kept."""
    x, last = num(name), len(edges) - 2
    place = F.lit(None).cast("long")
    for k in range(last, -1, -1):
        inside = (x >= edges[k]) & ((x <= edges[k + 1]) if k == last else (x < edges[k + 1]))
        place = F.when(inside, F.lit(k).cast("long")).otherwise(place)
    group = F.coalesce(col(by).cast("string"), F.lit(MISSING_LABEL))
    counts = df.select(group.alias("group"), place.alias("bin")).where("bin IS NOT NULL").groupBy("group", "bin").agg(F.count("*").alias("count"))
    grid = counts.select("group").distinct().select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("bin"))
    full = grid.join(counts, ["group", "bin"], "left").select("group", "bin", F.coalesce("count", F.lit(0)).alias("count"))
    part = W.partitionBy("group")
    share = F.col("count") / F.sum("count").over(part)
    return full.withColumn("share", share).withColumn("cumulative", F.sum("count").over(part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum("count").over(part))


def categorical_distribution(df: DataFrame, name: str, by: str, top: int = 10) -> DataFrame:
    """(group, value, count): the most frequent values of all groups, the rest as (other); zero counts are kept."""
    value, group = F.coalesce(col(name).cast("string"), F.lit(MISSING_LABEL)), F.coalesce(col(by).cast("string"), F.lit(MISSING_LABEL))
    counts = df.groupBy(group.alias("group"), value.alias("value")).agg(F.count("*").alias("count"))
    best = counts.groupBy("value").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "value").limit(top).select(F.col("value").alias("kept"))
    named = counts.join(F.broadcast(best), F.col("value") == F.col("kept"), "left").withColumn("value", F.coalesce("kept", F.lit(OTHER)))
    found = named.groupBy("group", "value").agg(F.sum("count").alias("count"))
    grid = found.select("group").distinct().crossJoin(F.broadcast(found.select("value").distinct()))
    return grid.join(found, ["group", "value"], "left").select("group", "value", F.coalesce("count", F.lit(0)).alias("count"))


def suggested_bins(df: DataFrame, name: str) -> int:
    """Freedman - Diaconis, else Sturges, within 2 .. 200."""
    row = one_row(df, F.count(num(name)).alias("n"), F.min(num(name)).alias("a"), F.max(num(name)).alias("b"), quantile(num(name), 0.25).alias("q1"), quantile(num(name), 0.75).alias("q3"))
    if not row["n"] or row["a"] == row["b"]:
        return 2
    width = 2 * (row["q3"] - row["q1"]) / row["n"] ** (1 / 3)
    bins = math.ceil((row["b"] - row["a"]) / width) if width > 0 else math.ceil(math.log2(row["n"]) + 1)
    return max(2, min(200, bins))


def stacked(frames: dict[str, DataFrame], label: str = "frame") -> DataFrame:
    """Frames one above another with a label; columns that a frame lacks are missing."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# -- target -----------------------------------------------------------------------------------


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    return with_total(counts, "count").withColumn("pct", 100 * F.col("count") / F.col("__total")).drop("__total")


def correlation_ratio(df: DataFrame, value: str, group: str) -> DataFrame:
    """(eta): the root of between-group over total squares."""
    rows = df.select(num(value).alias("x"), col(group).alias("g")).dropna()
    groups = rows.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum("x").alias("s"))
    whole = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return whole.select(F.when(F.col("q") - centre > 0, F.sqrt(F.greatest(F.lit(0.0), (F.col("b") - centre) / (F.col("q") - centre)))).alias("eta"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = df.select(col(a).alias("a"), col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("o"))
    left, right = pairs.groupBy("a").agg(F.sum("o").alias("na")), pairs.groupBy("b").agg(F.sum("o").alias("nb"))
    whole = pairs.agg(F.sum("o").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    joined = pairs.join(left, "a").join(right, "b").crossJoin(F.broadcast(whole))
    # Cells without rows add their expected count: in all n less what the seen cells expect.
    expected = F.col("na") * F.col("nb") / F.col("n")
    total = joined.agg(F.sum((F.col("o") - expected) * (F.col("o") - expected) / expected).alias("seen"), F.sum(expected).alias("met"), F.max("n").alias("n"), F.max("ka").alias("ka"), F.max("kb").alias("kb"))
    chi = F.col("seen") + F.col("n") - F.col("met")
    least = F.least(F.col("ka"), F.col("kb")) - 1
    return total.select(F.when(least > 0, F.sqrt(chi / (F.col("n") * least))).alias("v"))


def numeric_by_class(df: DataFrame, name: str, target: str) -> DataFrame:
    x = num(name)
    return df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), quantile(x, 0.5).alias("median"), F.max(x).alias("max"))


def class_rates(df: DataFrame, category: str, target: str) -> DataFrame:
    """(value, class, count, rate)."""
    value = F.coalesce(col(category).cast("string"), F.lit(MISSING_LABEL))
    counts = df.where(col(target).isNotNull()).groupBy(value.alias("value"), col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    return counts.withColumn("rate", F.col("count") / F.sum("count").over(W.partitionBy("value")))


def binned_target_mean(df: DataFrame, name: str, target: str, bins: int = 10) -> DataFrame:
    """(bin, count, low, high, mean) by quantile bins that are closed on the right."""
    rows = df.select(binned(df, name, bins).cast("long").alias("bin"), num(name).alias("x"), num(target).alias("y")).where("bin IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("bin").agg(F.count("*").alias("count"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("y").alias("mean"))


def association(df: DataFrame, names, target: str) -> DataFrame:
    """(column, mutual_info, measure, strength, f, rank) with a target of classes, ranked by mutual information.

    measure names strength: eta, the correlation ratio, with F of the analysis of variance for a number; Cramer's V for a category."""
    rows, numbers = [], [c for c in names if is_numeric(df, c)]
    words = {c: F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL)) for c in names if c not in numbers}
    information = mutual_information(df, bins_of(df, numbers) | words, coded(df, target)) if names else {}
    scores = f_scores(df, numbers, target, "classification") if numbers else {}
    for c in names:
        strength = correlation_ratio(df, c, target).first()["eta"] if c in numbers else cramers_v(df, c, target).first()["v"]
        rows.append((c, information[c], "eta" if c in numbers else "cramers_v", strength, scores.get(c)))
    rows.sort(key=lambda r: -r[1])
    return df.sparkSession.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], "column string, mutual_info double, measure string, strength double, f double, rank int")


def near_constant(df: DataFrame, names, share: float = 0.95) -> DataFrame:
    """(column, value, pct): columns of which one value (missing ones count too) has that share of the rows or more."""
    rows = df.count()
    out = []
    for c in names:
        top = df.groupBy(col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").first()
        if top and top["n"] >= share * rows:
            out.append((c, top["value"], 100 * top["n"] / rows))
    return df.sparkSession.createDataFrame(out, "column string, value string, pct double")


def pca_variance(df: DataFrame, names) -> DataFrame:
    """(component, share, cumulative): the variance that principal components of the standardised columns hold."""
    from loomwright.operators.base import get

    names = list(names)
    share = get("pca").fit(df, {"columns": names, "n_components": len(names)})["shares"]
    return df.sparkSession.createDataFrame([(k + 1, v, sum(share[: k + 1])) for k, v in enumerate(share)], "component int, share double, cumulative double")


# -- train and test ---------------------------------------------------------------------------


def ks(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """(ks): the largest gap of the two distribution functions."""
    both = train.select(num(name).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(test.select(num(name), F.lit(0), F.lit(1))).where("x IS NOT NULL")
    counts = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = running(counts, ["x"], ["a", "b"])
    whole = sums.agg(F.max("a_upto").alias("na"), F.max("b_upto").alias("nb"))
    gap = F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))
    return sums.crossJoin(F.broadcast(whole)).agg(F.max(gap).alias("ks"))


def psi(train: DataFrame, test: DataFrame, name: str, bins: int = PSI_BINS) -> DataFrame:
    """(psi) over bins of train's quantiles, closed on the right."""
    cuts = sorted(set(one_row(train, F.percentile(num(name), F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("q"))["q"] or []))
    place = F.lit(0)
    for cut in cuts:
        place = place + (num(name) > F.lit(cut)).cast("int")
    count = lambda d, k: d.where(num(name).isNotNull()).select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias(k))
    grid = train.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bin"))
    joined = grid.join(count(train, "a"), "bin", "left").join(count(test, "b"), "bin", "left").na.fill(0, ["a", "b"])
    whole = W.partitionBy()
    p, q = (F.greatest(F.col(k) / F.sum(k).over(whole), F.lit(PSI_EPSILON)) for k in ("a", "b"))
    return joined.select(((q - p) * F.log(q / p)).alias("t")).agg(F.sum("t").alias("psi"))


SIDES = ("train", "test")
DRIFT = ("mean", "std", "p1", "median", "p99", "min", "max")


def numeric_drift(train: DataFrame, test: DataFrame, names) -> DataFrame:
    """Per column, both sides' mean, std, p1, median, p99, min and max; SMD (pooled standard deviation), KS, PSI; shares of test below train's p1, above its p99 and outside its range; a severity.

    A column with under two known values on a side has only `skipped`. Every step is one aggregate over all columns, but for KS and PSI."""
    names, facts = list(names), {}
    for side, df in zip(SIDES, (train, test), strict=True):
        q, row = quantiles(df, {c: num(c) for c in names}, [0.01, 0.5, 0.99], *of_columns(df, names, n=F.count, mean=F.avg, std=F.stddev_samp, min=F.min, max=F.max))
        for i, c in enumerate(names):
            facts[side, c] = {k: row[f"{k}{i}"] for k in ("n", "mean", "std", "min", "max")} | dict(zip(("p1", "median", "p99"), q[c] or [None] * 3, strict=True))
    some = [c for c in names if all(facts[s, c]["n"] >= 2 for s in SIDES)]
    wanted = []
    for i, c in enumerate(some):
        own, x = facts["train", c], num(c)
        wanted += [(100 * F.avg((x < own["p1"]).cast("double"))).alias(f"below{i}"), (100 * F.avg((x > own["p99"]).cast("double"))).alias(f"above{i}"), (100 * F.avg(((x < own["min"]) | (x > own["max"])).cast("double"))).alias(f"outside{i}")]
    far = one_row(test, *wanted)
    rows = []
    for c in names:
        a, b = (facts[s, c] for s in SIDES)
        if c not in some:
            few = [s for s in SIDES if facts[s, c]["n"] < 2]
            rows.append((c, "under 2 known values in " + " and ".join(few), *[None] * (2 * len(DRIFT) + 7)))
            continue
        i, spread = some.index(c), math.sqrt((a["std"] ** 2 + b["std"] ** 2) / 2)
        smd = (b["mean"] - a["mean"]) / spread if spread else None
        k, s = ks(train, test, c).first()["ks"], psi(train, test, c).first()["psi"]
        level = "high" if s >= PSI_LEVELS[1] or abs(smd or 0) >= SMD_LEVEL or k >= KS_LEVEL or far[f"outside{i}"] >= OUTSIDE_LEVELS[1] else "medium" if s >= PSI_LEVELS[0] else "low"
        rows.append((c, None, *[facts[side, c][f] for side in SIDES for f in DRIFT], smd, k, s, far[f"below{i}"], far[f"above{i}"], far[f"outside{i}"], level))
    doubles = [f"{f}_{side}" for side in SIDES for f in DRIFT] + ["smd", "ks", "psi", "pct_test_below_train_p1", "pct_test_above_train_p99", "pct_test_outside_train_range"]
    return train.sparkSession.createDataFrame(rows, ", ".join(["column string, skipped string", *(f"{d} double" for d in doubles), "severity string"]))


def histogram_pair(train: DataFrame, test: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, train, test): each side's share over equal bins of both sides' range, the last closed."""
    both = train.select(num(name).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(test.select(num(name), F.lit(0), F.lit(1))).where("x IS NOT NULL")
    row = both.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if row["low"] is None:
        return train.sparkSession.createDataFrame([], "bin long, low double, high double, train double, test double")
    low, high = (row["low"], row["high"]) if row["high"] > row["low"] else (row["low"] - 0.5, row["high"] + 0.5)
    width = (high - low) / bins
    counts = both.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grid = train.sparkSession.range(bins).select(F.col("id").alias("bin"), (low + F.col("id") * width).alias("low"), (low + (F.col("id") + 1) * width).alias("high"))
    share = lambda k: (F.coalesce(k, F.lit(0)) / F.lit(max(1, row[k] or 0))).alias({"a": "train", "b": "test"}[k])
    return grid.join(counts, "bin", "left").select("bin", "low", "high", share("a"), share("b"))


def near_key(x):
    """A category as it is compared loosely: no white space or punctuation at its end, no capitals."""
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), r"[\p{Punct}]+$", ""))


def near_matches(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """(test, train): values that only test has and the value of train that they resemble, the least of several."""
    value = lambda d: d.where(col(name).isNotNull()).select(col(name).cast("string").alias("v")).distinct()
    known, other = value(train), value(test)
    homes = known.groupBy(near_key(F.col("v")).alias("key")).agg(F.min("v").alias("train"))
    return other.join(known, "v", "left_anti").withColumn("key", near_key(F.col("v"))).join(homes, "key").select(F.col("v").alias("test"), "train")


def row_counter(df: DataFrame, names) -> dict[str, bool]:
    """Whether each column counts rows: whole numbers without a gap from 0 or 1."""
    names = [c for c in names if isinstance(df.schema[c].dataType, INTEGRAL)]
    row = one_row(df, *[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max), ("d", F.count_distinct))])
    return {c: row[f"a{i}"] in (0, 1) and row[f"b{i}"] - row[f"a{i}"] + 1 == row[f"d{i}"] for i, c in enumerate(names)}


def id_overlap(train: DataFrame, test: DataFrame, names) -> DataFrame:
    """(column, n_test, n_test_in_train, pct_test_in_train): distinct ids of test that train has."""
    out = None
    for c in names:
        a, b = (d.where(col(c).isNotNull()).select(col(c).cast("string").alias("v")).distinct() for d in (train, test))
        both = b.join(a.withColumn("hit", F.lit(1)), "v", "left").agg(F.count("*").alias("n_test"), F.count("hit").alias("n_test_in_train"))
        part = both.select(F.lit(c).alias("column"), "n_test", "n_test_in_train", F.when(F.col("n_test") > 0, 100 * F.col("n_test_in_train") / F.col("n_test")).otherwise(0.0).alias("pct_test_in_train"))
        out = part if out is None else out.union(part)
    return out if out is not None else train.sparkSession.createDataFrame([], "column string, n_test long, n_test_in_train long, pct_test_in_train double")


def issues(train: DataFrame, test: DataFrame, target: str | None = None) -> DataFrame:
    """(column, issue, severity, detail): what a model trained on one side would meet on the other, the gravest first.

    Columns of one side only (the target excepted), other types, categories that train has not (high where
    they resemble one of train's: a spelling, else by their rows' share), and drift of numeric columns."""
    both = [c for c in names_of(train) if c in test.columns]
    found = [(c, "only_train", "high", "not there at prediction time") for c in names_of(train) if c not in test.columns and c != target]
    found += [(c, "only_test", "low", "no model can use it") for c in names_of(test) if c not in train.columns]
    kinds = {c: (train.schema[c].dataType, test.schema[c].dataType) for c in both}
    for c, (a, b) in kinds.items():
        if a != b and not (isinstance(a, NUMERIC) and isinstance(b, NUMERIC)):
            found.append((c, "type_mismatch", "high", f"{a.simpleString()} against {b.simpleString()}"))
        elif isinstance(a, T.StringType):
            new = unseen_values(train, test, c).where("side = 'test'")
            share = test.where(col(c).isNotNull()).select(col(c).cast("string").alias("value")).join(new, "value", "left_semi").count() / max(1, test.count())
            if share:
                spelled = near_matches(train, test, c).orderBy("test").limit(3).collect()
                what = f"{100 * share:.2f} % of rows" + "".join(f"; {r['test']!r} for {r['train']!r}" for r in spelled)
                found.append((c, "value_mismatch", "high" if spelled or 100 * share > OUTSIDE_LEVELS[1] else "low", what))
    numbers = [c for c, (a, b) in kinds.items() if isinstance(a, NUMERIC) and isinstance(b, NUMERIC)]
    counters = [row_counter(d, numbers) for d in (train, test)]
    numbers = [c for c in numbers if not all(r.get(c) for r in counters)]
    for r in numeric_drift(train, test, numbers).where("severity IN ('medium', 'high')").collect() if numbers else ():
        found.append((r["column"], "drift", r["severity"], f"psi {r['psi']:.3f}, ks {r['ks']:.3f}, {r['pct_test_outside_train_range']:.2f} % outside train's range"))
    grade = {"high": 0, "medium": 1, "low": 2}
    found.sort(key=lambda r: (grade[r[2]], r[0]))
    return train.sparkSession.createDataFrame(found, "column string, issue string, severity string, detail string")


def value_shares(df, name, alias):
    counts = df.groupBy(F.coalesce(col(name).cast("string"), F.lit(MISSING_LABEL)).alias("value")).agg(F.count("*").alias("n"))
    return with_total(counts, "n").select("value", (F.col("n") / F.col("__total")).alias(alias))


def categorical_shift(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """(value, train_share, test_share) of every value of either side."""
    joined = value_shares(train, name, "train_share").join(value_shares(test, name, "test_share"), "value", "full_outer")
    return joined.na.fill(0.0, ["train_share", "test_share"])


def total_variation(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    return categorical_shift(train, test, name).agg((F.sum(F.abs(F.col("train_share") - F.col("test_share"))) / 2).alias("tvd"))


def unseen_values(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """(value, side): values that only one frame has."""
    a, b = (d.where(col(name).isNotNull()).select(col(name).cast("string").alias("value")).distinct() for d in (train, test))
    return b.join(a, "value", "left_anti").withColumn("side", F.lit("test")).union(a.join(b, "value", "left_anti").withColumn("side", F.lit("train")))


def row_overlap(train: DataFrame, test: DataFrame, names) -> DataFrame:
    """(overlap): rows of test that train has, by the named columns; missing equals missing."""
    key = F.to_json(F.struct(*[col(c).cast("string").alias(c) for c in names]), {"ignoreNullFields": "false"})
    return test.select(key.alias("k")).join(train.select(key.alias("k")).distinct(), "k", "left_semi").agg(F.count("*").alias("overlap"))


def align_report(train: DataFrame, test: DataFrame, label: str | None = None) -> DataFrame:
    """(column, status, similar): label, match, missing_in_test, type_mismatch, value_mismatch (a category that train has not) or extra_in_test; similar names a column of the other side for one that has no partner."""
    rows = []
    ours, theirs = names_of(train), names_of(test)
    for c in ours:
        if c == label:
            rows.append((c, "label", None))
        elif c not in theirs:
            near = difflib.get_close_matches(c, [t for t in theirs if t not in ours], 1)
            rows.append((c, "missing_in_test", near[0] if near else None))
        else:
            a, b = train.schema[c].dataType, test.schema[c].dataType
            alike = a == b or isinstance(a, NUMERIC) and isinstance(b, NUMERIC)
            new = alike and isinstance(a, T.StringType) and unseen_values(train, test, c).where("side = 'test'").limit(1).count() > 0
            rows.append((c, "type_mismatch" if not alike else "value_mismatch" if new else "match", None))
    for c in theirs:
        if c not in ours:
            near = difflib.get_close_matches(c, [t for t in ours if t not in theirs and t != label], 1)
            rows.append((c, "extra_in_test", near[0] if near else None))
    return train.sparkSession.createDataFrame(rows, "column string, status string, similar string")


def vs_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """(method, corr, n): Pearson's and Spearman's correlation of two numeric columns over rows where both are known."""
    both = num(column).isNotNull() & num(by).isNotNull()
    row = one_row(df, F.corr(num(column), num(by)).alias("r"), F.count_if(both).alias("n"))
    found = [("pearson", _finite(row["r"]), row["n"]), ("spearman", _finite(spearman(df, column, by).first()["corr"]), row["n"])]
    return df.sparkSession.createDataFrame(found, "method string, corr double, n long")


def compare_columns(train: DataFrame, test: DataFrame) -> DataFrame:
    """(column, train_dtype, test_dtype, train_missing_pct, test_missing_pct, status)."""
    def rates(df):
        names = names_of(df)
        row = one_row(df, *[(100 * F.avg(col(c).isNull().cast("double"))).alias(f"m{i}") for i, c in enumerate(names)])
        return {c: (df.schema[c].dataType.simpleString(), row[f"m{i}"]) for i, c in enumerate(names)}

    a, b = rates(train), rates(test)
    rows = []
    for c in dict.fromkeys([*a, *b]):
        left, right = a.get(c, (None, None)), b.get(c, (None, None))
        status = "only_test" if c not in a else "only_train" if c not in b else "match" if left[0] == right[0] else "type_mismatch"
        rows.append((c, left[0], right[0], left[1], right[1], status))
    return train.sparkSession.createDataFrame(rows, "column string, train_dtype string, test_dtype string, train_missing_pct double, test_missing_pct double, status string")
