"""Missing values, outliers, duplicates and inconsistent spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.analysis.profile import CURRENCY, MONEY, clean, names_of, of_columns, plain, quantiles, unpivoted
from loomwright.errors import EngineError
from loomwright.functions.running import running
from loomwright.operators.base import NUMERIC, col, num
from loomwright.operators.text import NUMBER, stripped, unified

# Fixed values.
DROP_PERCENT = 60.0
REVIEW_PERCENT = 20.0
NUMERIC_SENTINELS = (-9999, -999, -99, -1, 999, 9999)
DATE_SENTINELS = ("1900-01-01", "1970-01-01", "0001-01-01")
STRING_SENTINELS = ("", "unknown", "n/a", "na", "nan", "none", "null", "nil", "-", "--", "?", "missing")
SPIKE_SHARE = 0.02
SPIKE_FACTOR = 3.0
SPIKE_ROWS = 5
JACCARD = 0.5
COOCCURRENCE_COLUMNS = 30
FUZZY_RATIO = 90.0
FUZZY_MOST = 2000
MOSTLY = 0.8
SKEWED = 1.0


def missing_rates(df: DataFrame) -> DataFrame:
    each = unpivoted(df, names_of(df), lambda c: clean(df, c).isNull().cast("int"))
    rate = 100 * F.sum("x") / F.count("*")
    advice = F.when(F.col("rate") > DROP_PERCENT, "drop").when(F.col("rate") > REVIEW_PERCENT, "review").when(F.col("rate") > 0, "impute").otherwise("complete")
    return each.groupBy("column").agg(F.sum("x").alias("missing"), rate.alias("rate")).withColumn("advice", advice)


def missing_per_row(df: DataFrame) -> DataFrame:
    """(missing, rows, spike): how many rows lack so many values."""
    names = names_of(df)
    total = F.lit(0)
    for c in names:
        total = total + clean(df, c).isNull().cast("int")
    counts = df.select(total.cast("long").alias("missing")).groupBy("missing").agg(F.count("*").alias("rows"))
    grid = df.sparkSession.range(len(names) + 1).select(F.col("id").alias("missing"))
    out = grid.join(F.broadcast(counts), "missing", "left").select("missing", F.coalesce("rows", F.lit(0)).alias("rows"))
    order = W.partitionBy().orderBy("missing")
    near = (F.coalesce(F.lag("rows").over(order), F.lit(0)) + F.coalesce(F.lead("rows").over(order), F.lit(0))) / (F.lag("rows").over(order).isNotNull().cast("int") + F.lead("rows").over(order).isNotNull().cast("int"))
    share = F.col("rows") / F.sum("rows").over(W.partitionBy())
    spike = (F.col("missing") > 0) & (share >= SPIKE_SHARE) & (F.col("rows") >= SPIKE_FACTOR * near)
    return out.withColumn("spike", spike.cast("int"))


def sentinel_counts(df: DataFrame) -> DataFrame:
    """(column, token, count): codes and words that stand for a missing value."""
    parts, numbers = [], []
    for c in names_of(df):
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            token = F.lower(stripped(col(c)))
            hit = token.isin(*STRING_SENTINELS) & (stripped(col(c)) != "MISSING")
        elif isinstance(dtype, NUMERIC):
            numbers.append(c)
            continue
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            token = F.date_format(col(c), "yyyy-MM-dd")
            hit = token.isin(*DATE_SENTINELS)
        else:
            continue
        parts.append(df.where(hit).groupBy(token.alias("token")).agg(F.count("*").alias("count")).select(F.lit(c).alias("column"), "token", "count"))
    out = df.sparkSession.createDataFrame(numeric_sentinels(df, numbers), "column string, token string, count long")
    for part in parts:
        out = out.union(part)
    return out


def numeric_sentinels(df: DataFrame, names: list[str]) -> list[tuple[str, str, int]]:
    """(column, token, count): codes outside the range of the other values, or far more frequent than the ten nearest ones.

    One aggregate finds which codes occur; only for those are the nearest values looked up."""
    codes = [float(v) for v in NUMERIC_SENTINELS]
    wanted = []
    for i, c in enumerate(names):
        others = F.when(~num(c).isin(codes), num(c))
        wanted += [F.min(others).alias(f"low{i}"), F.max(others).alias(f"high{i}"), *[F.count_if(num(c) == v).alias(f"n{i}_{k}") for k, v in enumerate(codes)]]
    row = df.agg(*wanted).first().asDict() if wanted else {}
    out = []
    for i, c in enumerate(names):
        for k, v in enumerate(codes):
            n, low, high = row[f"n{i}_{k}"], row[f"low{i}"], row[f"high{i}"]
            if not n:
                continue
            if low is None or v < low or v > high:
                out.append((c, str(int(v)), n))
            elif n >= SPIKE_ROWS:
                counts = df.select(num(c).alias("v")).where(F.col("v").isNotNull() & ~F.col("v").isin(codes)).groupBy("v").agg(F.count("*").alias("n"))
                near = counts.orderBy(F.abs(F.col("v") - v), "v").limit(10).agg(F.max("n").alias("n")).first()["n"]
                if n >= SPIKE_FACTOR * (near or 0):
                    out.append((c, str(int(v)), n))
    return out


def cooccurrence(df: DataFrame, least: float = JACCARD) -> DataFrame:
    """(a, b, jaccard) of columns that are missing together."""
    names = names_of(df)[:COOCCURRENCE_COLUMNS]
    gone = {c: clean(df, c).isNull() for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    schema = "a string, b string, jaccard double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    row = df.agg(*[F.count_if(gone[a] & gone[b]).alias(f"i{k}") for k, (a, b) in enumerate(pairs)], *[F.count_if(gone[a] | gone[b]).alias(f"u{k}") for k, (a, b) in enumerate(pairs)]).first()
    found = [(a, b, row[f"i{k}"] / row[f"u{k}"]) for k, (a, b) in enumerate(pairs) if row[f"u{k}"]]
    return df.sparkSession.createDataFrame([f for f in found if f[2] >= least], schema)


def value_spikes(train: DataFrame, test: DataFrame, name: str, top: int = 3) -> DataFrame:
    """Test's most frequent values that train hardly has."""
    count = lambda d, k: d.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias(k))
    n_test, n_train = (d.where(col(name).isNotNull()).count() for d in (test, train))
    often = count(test, "n_test").orderBy(F.desc("n_test"), "value").limit(top)
    share, before = F.col("n_test") / max(1, n_test), F.coalesce("n_train", F.lit(0)) / max(1, n_train)
    return often.join(count(train, "n_train"), "value", "left").select("value", "n_test", F.coalesce("n_train", F.lit(0)).alias("n_train"), share.alias("test_share"), before.alias("train_share")).where((F.col("n_test") >= 10) & (F.col("test_share") >= 0.01) & (F.col("test_share") >= 10 * F.col("train_share")))


# -- outliers ---------------------------------------------------------------------------------


def univariate_outliers(df: DataFrame, names) -> DataFrame:
    """(column, n, n_iqr, n_z, n_mad); every step is one aggregate over all columns."""
    names = list(names)
    q, row = quantiles(df, {c: num(c) for c in names}, [0.25, 0.5, 0.75], *of_columns(df, names, n=F.count, mean=F.avg, std=F.stddev_samp))
    some = [(i, c) for i, c in enumerate(names) if row[f"n{i}"]]
    mad, _ = quantiles(df, {c: F.abs(num(c) - q[c][1]) for _, c in some}, [0.5])
    wanted = []
    for i, c in some:
        x, (q1, median, q3), reach = num(c), q[c], 1.5 * (q[c][2] - q[c][0])
        wanted.append(F.count_if((x < q1 - reach) | (x > q3 + reach)).alias(f"iqr{i}"))
        wanted.append((F.count_if(F.abs(x - row[f"mean{i}"]) > 3 * row[f"std{i}"]) if row[f"std{i}"] else F.lit(0).cast("long")).alias(f"z{i}"))
        wanted.append((F.count_if(0.6745 * F.abs(x - median) / mad[c][0] > 3.5) if mad[c][0] > 0 else F.lit(0).cast("long")).alias(f"mad{i}"))
    found = df.agg(*wanted).first().asDict() if wanted else {}
    rows = [(c, row[f"n{i}"], *(found.get(f"{k}{i}", 0) for k in ("iqr", "z", "mad"))) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column string, n long, n_iqr long, n_z long, n_mad long")


def box_stats(df: DataFrame, names) -> DataFrame:
    """(column, q1, median, q3, low_fence, high_fence, low_whisker, high_whisker, below, above)."""
    q, _ = quantiles(df, {c: num(c) for c in names}, [0.25, 0.5, 0.75])
    fences = {c: (v[0] - 1.5 * (v[2] - v[0]), v[2] + 1.5 * (v[2] - v[0])) for c, v in q.items() if v}
    wanted = []
    for i, (c, (low, high)) in enumerate(fences.items()):
        x = num(c)
        wanted += [F.min(F.when(x >= low, x)).alias(f"a{i}"), F.max(F.when(x <= high, x)).alias(f"b{i}"), F.count_if(x < low).alias(f"u{i}"), F.count_if(x > high).alias(f"o{i}")]
    row = df.agg(*wanted).first().asDict() if wanted else {}
    rows = [(c, *q[c], *fences[c], *(row[f"{k}{i}"] for k in "abuo")) for i, c in enumerate(fences)]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double, low_fence double, high_fence double, low_whisker double, high_whisker double, below long, above long")


def outlier_values(df: DataFrame, name: str, top: int = 20) -> DataFrame:
    """(value, count, side) of the values outside the box fences, the farthest first; top of them is the feature."""
    fence = box_stats(df, [name]).first()
    if fence is None:
        return df.sparkSession.createDataFrame([], "value double, count long, side string")
    x = F.col("value")
    rows = df.select(num(name).alias("value")).where((x < fence["low_fence"]) | (x > fence["high_fence"])).groupBy("value").agg(F.count("*").alias("count"))
    far = F.greatest(F.lit(fence["low_fence"]) - x, x - F.lit(fence["high_fence"]))
    return rows.withColumn("side", F.when(x < fence["low_fence"], "low").otherwise("high")).orderBy(far.desc(), "value").limit(top)


def isolation_scores(df: DataFrame, names, key: str, trees: int = 100, rows: int = 256, seed: int = 0) -> DataFrame:
    """(key, score) of an isolation forest: trees from samples of `rows` rows (the method's own bound), every row scored."""
    import numpy as np
    import pandas as pd

    medians = df.agg(*[F.median(num(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    fill = [m if m is not None else 0.0 for m in medians]
    values = [F.coalesce(num(c), F.lit(fill[i])).alias(f"x{i}") for i, c in enumerate(names)]
    draw = df.select(*values, F.xxhash64(F.lit(seed), col(key)).alias("__h")).orderBy("__h").limit(trees * rows // 4).drop("__h").collect()
    sample = np.array([list(r) for r in draw], dtype=float).reshape(-1, len(names))
    rng = np.random.default_rng(seed)
    size = min(rows, len(sample))

    def normal(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x, depth):
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(len(names))
        if len(x) < 2 or depth == 0 or not (spread > 0).any():
            return normal(len(x))
        j = int(rng.choice(np.flatnonzero(spread > 0)))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        left = x[:, j] < cut
        return j, cut, grow(x[left], depth - 1), grow(x[~left], depth - 1)

    forest = [grow(sample[rng.choice(len(sample), size, replace=False)], int(np.ceil(np.log2(max(2, size))))) for _ in range(trees)] if size else []

    def paths(tree, x, at, out, depth=0.0):
        if not isinstance(tree, tuple):
            out[at] += depth + tree
            return
        j, cut, a, b = tree
        left = x[at, j] < cut
        if left.any():
            paths(a, x, at[left], out, depth + 1)
        if not left.all():
            paths(b, x, at[~left], out, depth + 1)

    def solve(columns: pd.DataFrame) -> pd.Series:
        x = columns.to_numpy(dtype=float)
        out = np.zeros(len(x))
        for tree in forest:
            paths(tree, x, np.arange(len(x)), out)
        return pd.Series(2 ** (-out / max(1, len(forest)) / max(1e-9, normal(size))))

    solve.__annotations__ = {"columns": pd.DataFrame, "return": pd.Series}
    score = F.pandas_udf(solve, "double")
    return df.select(col(key), score(F.struct(*values)).alias("score"))


# -- duplicates -------------------------------------------------------------------------------


def exact_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """(redundant, involved, groups): counts of repeated rows."""
    subset = subset or names_of(df)
    counts = df.groupBy(*[plain(df, c).alias(c) for c in subset]).agg(F.count("*").alias("__n")).where("__n > 1")
    return counts.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("redundant"), F.coalesce(F.sum("__n"), F.lit(0)).alias("involved"), F.count("*").alias("groups"))


def duplicate_groups(df: DataFrame, subset, order: str) -> DataFrame:
    """Rows of repeated keys with a group number, by first appearance in order."""
    keys = [f"__k{i}" for i in range(len(subset))]
    tagged = df.withColumns({k: plain(df, c) for k, c in zip(keys, subset, strict=True)})
    groups = tagged.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(col(order)).alias("__first")).where("__n > 1").withColumn("__one", F.lit(1).cast("long"))
    groups = running(groups, ["__first"], ["__one"]).withColumnsRenamed({k: f"{k}_" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return tagged.join(groups, same).withColumn("group", F.col("__one_upto")).drop(*keys, *(f"{k}_" for k in keys), "__n", "__first", "__one", "__one_upto")


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """(column, keys): how many repeated keys disagree on a column; missing counts as a value."""
    others = [c for c in names_of(df) if c != key]
    value = lambda c: F.to_json(F.struct(col(c).alias("v")))
    per = df.groupBy(col(key)).agg(F.count("*").alias("__n"), *[(F.count_distinct(value(c)) > 1).cast("long").alias(f"__{i}") for i, c in enumerate(others)]).where("__n > 1")
    each = unpivoted(per, others, lambda c: F.col(f"__{others.index(c)}"))
    return each.groupBy("column").agg(F.sum("x").alias("keys"))


# -- spellings --------------------------------------------------------------------------------


def normal_form(x):
    return F.lower(stripped(unified(x)))


def variants(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """(value, canonical, count) of spellings that share a normal form; the most frequent is canonical, the first of ties (by order, else by text)."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count("*").alias("count"), (F.min(col(order)) if order else F.min(F.lit(0))).alias("first"))
    tagged = counts.withColumn("form", normal_form(F.col("value")))
    part = W.partitionBy("form")
    best = F.first("value").over(part.orderBy(F.desc("count"), "first", "value"))
    return tagged.withColumn("n", F.count("*").over(part)).withColumn("canonical", best).where("n > 1").select("value", "canonical", "count")


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    previous = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(previous[j] + 1 if x == y else max(previous[j + 1], row[j]))
        previous = row
    total = len(a) + len(b)
    return 100.0 if not total else 100.0 * 2 * previous[-1] / total


def fuzzy_variants(df: DataFrame, name: str) -> list[list[str]]:
    """Greedy clusters of similar normal forms of up to 30 characters. A column of over FUZZY_MOST such forms is refused: it is free text rather than spellings."""
    counts = df.where(col(name).isNotNull()).groupBy(normal_form(col(name)).alias("form")).agg(F.count("*").alias("n"))
    forms = counts.where(F.char_length("form") <= 30).orderBy(F.desc("n"), "form").limit(FUZZY_MOST + 1).collect()
    if len(forms) > FUZZY_MOST:
        raise EngineError(f"column {name!r} has over {FUZZY_MOST} spellings")
    heads: list[list[str]] = []
    for row in forms:
        form = row["form"]
        if not any(c.isalpha() for c in form):
            continue
        home = next((h for h in heads if indel_ratio(h[0], form) >= FUZZY_RATIO), None)
        home.append(form) if home else heads.append([form])
    return [h for h in heads if len(h) > 1]


def mixed_types(df: DataFrame, name: str) -> DataFrame:
    x = stripped(col(name))
    number = x.rlike(NUMBER)
    return df.agg(F.count_if(number).alias("numbers"), F.count_if(col(name).isNotNull() & ~number).alias("texts"))


#: (name of the form, pattern)
DATE_FORMS = (
    ("YYYY-MM-DD", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("YYYY/MM/DD", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("YYYYMMDD", r"^(19|20)\d{6}$"), ("DD Mon YYYY", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"),
)


def date_format(x):
    out = F.lit(None).cast("string")
    a = F.regexp_extract(x, r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$", 1).try_cast("int")
    b = F.regexp_extract(x, r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$", 3).try_cast("int")
    mark = F.regexp_extract(x, r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$", 2)
    order = F.when(a > 12, F.concat(F.lit("DD"), mark, F.lit("MM"))).when(b > 12, F.concat(F.lit("MM"), mark, F.lit("DD"))).otherwise(F.concat(F.lit("??"), mark, F.lit("??")))
    out = F.when(a.isNotNull(), order)
    for name, form in DATE_FORMS:
        out = out.when(x.rlike(form), name)
    return out


def date_formats(df: DataFrame, name: str) -> DataFrame:
    """(format, count) of the written dates of a text column."""
    x = stripped(col(name))
    return df.select(date_format(x).alias("format")).where("format IS NOT NULL").groupBy("format").agg(F.count("*").alias("count"))


def ambiguous_dates(df: DataFrame, name: str) -> DataFrame:
    """(dates, ambiguous): written day-month pairs, and those that read either way."""
    x = stripped(col(name))
    form = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$"
    a, b = (F.regexp_extract(x, form, k).try_cast("int") for k in (1, 3))
    return df.agg(F.count_if(x.rlike(form)).alias("dates"), F.count_if((a <= 12) & (b <= 12) & (a != b)).alias("ambiguous"))


def text_facts(df: DataFrame) -> DataFrame:
    """(column, spellings, forms, looks_like_dates, numbers_as_text, currency_as_text, skewed): one aggregate for all columns.

    spellings and forms are a text column's distinct values, raw and in normal form; the flags hold where
    most known values (MOSTLY) are written so. A number is only skewed or not."""
    names, wanted = names_of(df), []
    for i, c in enumerate(names):
        if isinstance(df.schema[c].dataType, T.StringType):
            x = stripped(col(c))
            x = F.when(x != "", x)
            bare = stripped(F.regexp_replace(x, CURRENCY, ""))
            wanted += [
                F.count(x).alias(f"n{i}"), F.count_distinct(col(c)).alias(f"raw{i}"), F.count_distinct(normal_form(col(c))).alias(f"form{i}"), F.count_if(date_format(x).isNotNull()).alias(f"date{i}"),
                F.count_if(x.rlike(NUMBER)).alias(f"num{i}"), F.count_if(x.rlike(CURRENCY) & bare.rlike(MONEY)).alias(f"cur{i}"),
            ]
        elif isinstance(df.schema[c].dataType, NUMERIC):
            wanted.append(F.skewness(num(c)).alias(f"skew{i}"))
    row = df.agg(*wanted).first().asDict() if wanted else {}
    rows = []
    for i, c in enumerate(names):
        if f"n{i}" in row:
            n = row[f"n{i}"]
            most = lambda k: bool(n) and row[f"{k}{i}"] >= MOSTLY * n  # noqa: B023, E731
            rows.append((c, row[f"raw{i}"], row[f"form{i}"], most("date"), most("num"), most("cur"), False))
        elif f"skew{i}" in row:
            rows.append((c, 0, 0, False, False, False, abs(row[f"skew{i}"] or 0) > SKEWED))
    return df.sparkSession.createDataFrame(rows, "column string, spellings long, forms long, looks_like_dates boolean, numbers_as_text boolean, currency_as_text boolean, skewed boolean")
