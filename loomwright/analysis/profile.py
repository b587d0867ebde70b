"""Column facts, semantic types and statistics. One aggregate serves all columns of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.running import ranged_quantiles
from loomwright.operators.base import INTEGRAL, NUMERIC, RID, col, num
from loomwright.operators.text import NUMBER, stripped

# Fixed values of the semantic types.
ID_RATIO = 0.95
TEXT_RATIO = 0.5
ID_LEAST = 20
DENSITY = 0.95
GROUP_LEAST = 100
GROUP_RATIO = 0.01
NUMERIC_TEXT = 0.8
MISSING_LABEL = "(missing)"
RARE_PERCENT = 1.0
BINS = 30
#: Frames of more rows get approximate distinct counts and quartiles.
EXACT_ROWS = 1_000_000
#: There a column of at most so many distinct values by its estimate is counted exactly all the same.
EXACT_DISTINCT = 100_000

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
MONEY = r"^[+-]?\d{1,3}(?:[,. \x{A0}\x{202F}]\d{3})*(?:[.,]\d+)?%?$"
CURRENCY = r"(?i)[$€£]|USD|EUR|GBP"


def names_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def clean(df: DataFrame, name: str) -> Column:
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def plain(df: DataFrame, name: str) -> Column:
    """A value that can be counted apart: nested ones as JSON."""
    if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    return clean(df, name)


def facts(df: DataFrame, exact: bool | None = None) -> dict[str, dict]:
    """Per column: rows, n, distinct, and what its type's decision needs."""
    if exact is None:
        exact = df.limit(EXACT_ROWS + 1).count() <= EXACT_ROWS
    count_distinct = F.count_distinct if exact else F.approx_count_distinct
    wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names_of(df)):
        x, dtype = plain(df, name), df.schema[name].dataType
        wanted += [F.count(x).alias(f"n{i}"), count_distinct(x).alias(f"distinct{i}")]
        if isinstance(dtype, NUMERIC):
            v = num(name)
            wanted += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.every(v == F.floor(v)).alias(f"whole{i}")]
        elif isinstance(dtype, T.StringType):
            raw = stripped(x)
            money = F.regexp_replace(stripped(F.regexp_replace(F.regexp_replace(raw, CURRENCY, ""), r"\s*%$", "%")), r"[.,]-$", "")
            wanted += [
                F.every(raw.rlike(ISO)).alias(f"iso{i}"), F.every(raw.rlike(r"^\d+$")).alias(f"digits{i}"), F.sum(raw.rlike(NUMBER).cast("int")).alias(f"parsed{i}"),
                F.sum(money.rlike(MONEY).cast("int")).alias(f"money{i}"), F.count_if(x.rlike(r"\s")).alias(f"spaced{i}"), F.max(F.length(x)).alias(f"long{i}"),
            ]
    row = df.agg(*wanted).first().asDict()
    if not exact:
        again = [i for i in range(len(names_of(df))) if row[f"distinct{i}"] <= EXACT_DISTINCT]
        if again:
            row |= df.agg(*[F.count_distinct(plain(df, names_of(df)[i])).alias(f"distinct{i}") for i in again]).first().asDict()
        # An estimate may exceed the values that there are.
        row |= {f"distinct{i}": min(row[f"distinct{i}"], row[f"n{i}"]) for i in range(len(names_of(df)))}
    out = {}
    for i, name in enumerate(names_of(df)):
        own = {k.removesuffix(str(i)): v for k, v in row.items() if k != "rows" and k.rstrip("0123456789") + str(i) == k}
        out[name] = own | {"rows": row["rows"], "dtype": df.schema[name].dataType}
    return out


def semantic_type(f: dict) -> str:
    """The decision tree over a column's facts; the order matters."""
    n, distinct, dtype = f["n"], f["distinct"], f["dtype"]
    if distinct <= 1:
        return "constant"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    ratio = distinct / n
    if isinstance(dtype, NUMERIC):
        if distinct == 2 and (f["min"], f["max"]) == (0, 1):
            return "boolean"
        dense = distinct / (f["max"] - f["min"] + 1) if f["whole"] else 0
        if isinstance(dtype, INTEGRAL) and n == f["rows"] and dense >= DENSITY:
            if ratio >= ID_RATIO and n >= ID_LEAST:
                return "id_like"
            if distinct >= GROUP_LEAST and GROUP_RATIO <= ratio < ID_RATIO:
                return "group_id"
        return "numeric"
    if f["iso"] and not f["digits"]:
        return "datetime"
    if max(f["parsed"] or 0, f["money"] or 0) < NUMERIC_TEXT * n and not f["spaced"]:
        if ratio >= ID_RATIO and n >= ID_LEAST:
            return "id_like"
        if distinct >= GROUP_LEAST and GROUP_RATIO <= ratio < ID_RATIO:
            return "group_id"
    return "text" if ratio > TEXT_RATIO else "categorical"


def column_profile(df: DataFrame, exact: bool | None = None, found: dict[str, dict] | None = None) -> DataFrame:
    """(column, dtype, semantic, rows, missing, unique); exact or estimated distinct counts, by default as facts decides, or those of the facts found."""
    rows = [(c, f["dtype"].simpleString(), semantic_type(f), f["rows"], f["rows"] - f["n"], f["distinct"]) for c, f in (facts(df, exact) if found is None else found).items()]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, semantic string, rows long, missing long, n_unique long")


def unpivoted(df: DataFrame, names, value) -> DataFrame:
    """(column, x): one row for each row and column."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("x")) for c in names])).alias("e")).select("e.*")


def quantile(x, share: float) -> Column:
    return F.percentile(x, F.lit(share))


#: Columns of more distinct values have their quantiles from ranged places, not from one task's table of values.
PLACED_DISTINCT = 2_000_000


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float], *extra: Column) -> tuple[dict[str, list[float] | None], dict]:
    """(exact quantiles of each expression, what the extra aggregates give): one aggregate for all columns, but for those of very many distinct values."""
    names = list(values)
    many = df.agg(*[F.approx_count_distinct(values[c]).alias(f"d{i}") for i, c in enumerate(names)]).first() if names else ()
    here = [i for i in range(len(names)) if many[i] <= PLACED_DISTINCT]
    wanted = [F.percentile(values[names[i]], F.array(*map(F.lit, shares))).alias(f"q{i}") for i in here] + list(extra)
    row = df.agg(*wanted).first().asDict() if wanted else {}
    return {c: row.get(f"q{i}") if i in here else ranged_quantiles(df, values[c], shares) for i, c in enumerate(names)}, row


def of_columns(df: DataFrame, names, **aggregates) -> list[Column]:
    """Each aggregate of each column, named by the column's place."""
    return [f(num(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in aggregates.items()]


SHARES = {"p1": 0.01, "p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_stats(df: DataFrame, names) -> DataFrame:
    """Moments (bias-corrected skew and kurtosis), quantiles and outlier counts: one row for each column, from three aggregates over all columns."""
    names = list(names)
    first = of_columns(df, names, count=F.count, mean=F.avg, std=F.stddev_samp, min=F.min, max=F.max, g1=F.skewness, g2=F.kurtosis, zeros=lambda x: F.count_if(x == 0), negatives=lambda x: F.count_if(x < 0))
    q, row = quantiles(df, {c: num(c) for c in names}, list(SHARES.values()), *first)
    far, out = [], []
    for i, c in enumerate(names):
        own = {k: row[f"{k}{i}"] for k in ("count", "mean", "std", "min", "max", "zeros", "negatives")} | dict(zip(SHARES, q[c] or [None] * len(SHARES), strict=True))
        n, spread = own["count"], own["std"] or 0
        own["skew"] = row[f"g1{i}"] * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and spread > 0 else None
        own["kurtosis"] = ((n + 1) * row[f"g2{i}"] + 6) * (n - 1) / ((n - 2) * (n - 3)) if n > 3 and spread > 0 else None
        out.append({"column": c} | own)
        if n:
            reach = 1.5 * (own["q3"] - own["q1"])
            far += [F.count_if((num(c) < own["q1"] - reach) | (num(c) > own["q3"] + reach)).alias(f"iqr{i}"), F.count_if(F.abs(num(c) - own["mean"]) > 3 * (own["std"] if own["std"] is not None else float("inf"))).alias(f"z{i}")]
    found = df.agg(*far).first().asDict() if far else {}
    rows = [o | {"iqr_outliers": found.get(f"iqr{i}", 0), "z_outliers": found.get(f"z{i}", 0)} for i, o in enumerate(out)]
    whole = ("count", "zeros", "negatives", "iqr_outliers", "z_outliers")
    order = ["column", "count", "mean", "std", "min", "max", *SHARES, "zeros", "negatives", "skew", "kurtosis", "iqr_outliers", "z_outliers"]
    schema = ", ".join(f"{k} {'string' if k == 'column' else 'long' if k in whole else 'double'}" for k in order)
    return df.sparkSession.createDataFrame([tuple(r[k] for k in order) for r in rows], schema)


def histogram(df: DataFrame, name: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, count) of equal widths, the last closed."""
    edges = df.agg(F.min(num(name)).alias("low"), F.max(num(name)).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    tagged = df.select(num(name).alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(edges)).withColumn("bin", place.cast("long"))
    counts = tagged.groupBy("bin").agg(F.count("*").alias("count"))
    grid = edges.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "low", width.alias("width"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def category_values(df: DataFrame, name: str) -> DataFrame:
    counts = df.groupBy(F.coalesce(col(name).cast("string"), F.lit(MISSING_LABEL)).alias("value")).agg(F.count("*").alias("count"))
    return with_total(counts, "count").withColumn("pct", 100 * F.col("count") / F.col("__total")).drop("__total")


def with_total(counts: DataFrame, name: str) -> DataFrame:
    """counts with __total, the sum of a column: one row that is broadcast."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(name).alias("__total"))))


def category_summary(df: DataFrame, name: str) -> DataFrame:
    values = category_values(df, name)
    return values.agg(
        F.count_if(F.col("value") != MISSING_LABEL).alias("cardinality"), F.max_by("value", F.struct("count", F.lit(1))).alias("top_value"),
        F.max("pct").alias("top_pct"), F.sum(F.when(F.col("pct") < RARE_PERCENT, F.col("pct")).otherwise(0.0)).alias("rare_pct"),
    )


def datetime_stats(df: DataFrame, name: str) -> DataFrame:
    x = col(name).cast("timestamp_ntz")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    span = (F.unix_micros(F.max(x).cast("timestamp")) - F.unix_micros(F.min(x).cast("timestamp"))) / 86_400_000_000.0
    return df.agg(F.count(x).alias("count"), iso(F.min(x)).alias("min"), iso(F.max(x)).alias("max"), span.alias("span_days"))


def text_stats(df: DataFrame, name: str) -> DataFrame:
    size = F.char_length(col(name))
    return df.agg(F.count_distinct(col(name)).alias("distinct"), F.avg(size).alias("mean_length"), F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"))


def id_stats(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_distinct(col(name)).alias("distinct"), (F.count(col(name)) - F.count_distinct(col(name))).alias("duplicates"))


def alerts(df: DataFrame, found: dict[str, dict] | None = None) -> list[dict]:
    """Plain warnings from the facts."""
    out, found = [], facts(df) if found is None else found
    rows = next(iter(found.values()))["rows"] if found else 0
    if not rows:
        return [{"alert": "empty", "column": None}]
    for name, f in found.items():
        kind = semantic_type(f)
        if f["n"] < rows and (rows - f["n"]) / rows > 0.2:
            out.append({"alert": "missing", "column": name})
        if kind in ("constant", "id_like"):
            out.append({"alert": kind, "column": name})
        if kind == "categorical" and f["distinct"] > 50:
            out.append({"alert": "cardinality", "column": name})
    return out
