"""Registered queries over the driver's tables, with their SQL oracles.

Aggregated doubles are floored at four decimals on both sides, as their summation order differs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.analysis import cleanliness, joins, profile, relations
from loomwright.functions.formula import evaluate
from loomwright.operators import get
from loomwright.operators.contract import findings_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same split of orders into train and test on both sides.
SPLIT = "1996-01-01"


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def step(df, op, /, **params) -> DataFrame:
    return get(op).fit_apply(df, params)


def rounded(df, *keep) -> DataFrame:
    """Doubles floored at four decimals, but for the columns keep."""
    def f(field):
        c = F.col(field.name)
        return (F.floor(c * 1e4 + 0.5) / 1e4).alias(field.name) if isinstance(field.dataType, T.DoubleType) and field.name not in keep else c

    return df.select(*map(f, df.schema))


def r4(sql: str) -> str:
    return f"floor(({sql})*1e4+0.5)/1e4"


def lineitem(spark, d, *columns):
    return table(spark, d, "lineitem").select(*columns)


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINE_COLUMNS = LINE.split(", ")


def gaps(spark, d) -> DataFrame:
    """events with a missing value in every seventh row."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END").alias("value"))


GAPS = "(SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


def sides(spark, d):
    orders = table(spark, d, "orders")
    return orders.where(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz")), orders.where(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz"))


TRAIN, TEST = f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}')", f"(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace_slice(spark, sf_dir)


# -- SQL that several oracles share -------------------------------------------------------------


def grid_sql(x, grid, places):
    """The value at a place (from 0) of a list of points, linear between them."""
    i = f"CAST(least(floor({places}), len({grid}) - 2) AS BIGINT)"
    return f"({grid}[{i} + 1] + ({places} - {i}) * ({grid}[{i} + 2] - {grid}[{i} + 1]))"


def shares_sql(n):
    return "[" + ", ".join(repr(k / (n - 1)) for k in range(n)) + "]"


ALIGN_SQL = f"""WITH g AS (SELECT quantile_cont(o_totalprice, {shares_sql(20)}) AS q FROM {TRAIN}),
t AS (SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 - 1) / (count(*) OVER () - 1) * 19 AS place FROM {TEST})
SELECT o_orderkey, {r4(grid_sql("", "q", "place"))} AS o_totalprice FROM t, g"""


def power_sql():
    """Five grids of 17, each round the best of the one before; the gain is the log-likelihood of the powers as normal."""
    out = ["WITH x AS (SELECT o_orderkey, o_totalprice AS x FROM orders), t AS (SELECT count(*) AS n, sum(ln(1 + x)) AS s FROM x), b0 AS (SELECT 1.0::DOUBLE AS lam, -3.0::DOUBLE AS low, 5.0::DOUBLE AS high)"]
    for k in range(5):
        out.append(f"""g{k} AS (SELECT low + i * ((high - low) / 16) AS lam, (high - low) / 16 AS step FROM b{k}, range(17) r(i)),
v{k} AS (SELECT lam, any_value(step) AS step, var_pop(CASE WHEN abs(lam) < 1e-8 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END) AS v FROM x, g{k} GROUP BY lam),
b{k + 1} AS (SELECT lam, lam - step AS low, lam + step AS high FROM v{k}, t ORDER BY -n / 2.0 * ln(v) + (lam - 1) * s DESC, lam LIMIT 1)""")
    out.append("y AS (SELECT o_orderkey, CASE WHEN abs(lam) < 1e-8 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END AS y FROM x, b5), m AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM y)")
    return ", ".join(out) + f" SELECT o_orderkey, {r4('(y - m) / s')} AS o_totalprice FROM y, m"


QUANTILE_SQL = f"""WITH q AS (SELECT quantile_cont(o_totalprice, {shares_sql(100)}) AS q FROM orders),
p AS (SELECT o_orderkey, o_totalprice AS x, q, least(greatest(len(list_filter(q, lambda v: v <= o_totalprice)), 1), 99) AS i FROM orders, q),
u AS (SELECT o_orderkey, least(greatest((i - 1 + (x - q[i]) / (q[i + 1] - q[i])) / 99, 1e-7), 1 - 1e-7) AS u FROM p),
t AS (SELECT o_orderkey, u, sqrt(-2 * ln(least(u, 1 - u))) AS t FROM u),
z AS (SELECT o_orderkey, u, t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308))) AS z FROM t)
SELECT o_orderkey, {r4("CASE WHEN u < 0.5 THEN -z ELSE z END")} AS o_totalprice FROM z"""


def spline_sql():
    """Cox - de Boor over five even knots, degree 3, one CTE for each degree."""
    knot = lambda i: f"(a + ({i} - 3) * h)"
    out = [f"WITH e AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, (max(p_retailprice) - min(p_retailprice)) / 4 AS h FROM part), d0 AS (SELECT p_partkey, least(greatest(p_retailprice, a), a + 4 * h) AS x, a, h, " + ", ".join(f"CASE WHEN least(greatest(p_retailprice, a), a + 4 * h) >= {knot(i)} AND least(greatest(p_retailprice, a), a + 4 * h) {'<=' if i == 6 else '<'} {knot(i + 1)} THEN 1.0::DOUBLE ELSE 0 END AS b{i}" if i <= 6 else f"0.0::DOUBLE AS b{i}" for i in range(10)) + " FROM part, e)"]
    for d in range(1, 4):
        out.append(f"d{d} AS (SELECT p_partkey, x, a, h, " + ", ".join(f"(x - {knot(i)}) / ({d} * h) * b{i} + ({knot(i + d + 1)} - x) / ({d} * h) * b{i + 1} AS b{i}" for i in range(10 - d)) + f" FROM d{d - 1})")
    return ", ".join(out) + " SELECT p_partkey, " + ", ".join(f"{r4(f'b{i}')} AS p_retailprice_sp{i}" for i in range(7)) + " FROM d3"


def pca_sql():
    """Eigenvalues of a symmetric 3 x 3 matrix by its characteristic cubic, vectors as cross products of its shifted rows."""
    names = ("l_quantity", "l_discount", "l_tax")
    pairs = ((0, 1), (0, 2), (1, 2))
    cells = ", ".join(f"corr({names[i]}, {names[j]}) AS r{i}{j}" for i, j in pairs)
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(names))
    # Correlations: the matrix less the unit; its trace is 0.
    vector = lambda k: f"""v{k} AS (SELECT *, (r01 * r12 - r02 * (0 - l{k})) AS x{k}, (r02 * r01 - (0 - l{k}) * r12) AS y{k}, ((0 - l{k}) * (0 - l{k}) - r01 * r01) AS z{k} FROM {'l' if k == 1 else 'n1'}),
n{k} AS (SELECT *, sqrt(x{k} * x{k} + y{k} * y{k} + z{k} * z{k}) * CASE WHEN (CASE WHEN abs(x{k}) >= abs(y{k}) AND abs(x{k}) >= abs(z{k}) THEN x{k} WHEN abs(y{k}) >= abs(z{k}) THEN y{k} ELSE z{k} END) < 0 THEN -1 ELSE 1 END AS w{k} FROM v{k})"""  # noqa: E731
    return f"""WITH c AS (SELECT {cells}, {moments} FROM lineitem), p AS (SELECT *, sqrt((r01 * r01 + r02 * r02 + r12 * r12) / 3) AS p FROM c),
f AS (SELECT *, acos(least(greatest(r01 * r02 * r12 / (p * p * p), -1), 1)) / 3 AS f FROM p), l AS (SELECT *, 2 * p * cos(f) AS l1, 2 * p * cos(f - 2 * pi() / 3) AS l2 FROM f),
{vector(1)}, {vector(2)}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, """ + ", ".join(r4(f"((l_quantity - m0) / s0 * x{k} + (l_discount - m1) / s1 * y{k} + (l_tax - m2) / s2 * z{k}) / w{k}") + f" AS pc{k}" for k in (1, 2)) + " FROM lineitem, n2"


def bins_sql(x, t, n=20):
    """A value's bin by a frame's quantiles, closed on the right; repeated cuts count once."""
    cuts = "[" + ", ".join(repr(k / n) for k in range(1, n)) + "]"
    return f"len(list_filter((SELECT list_distinct(quantile_cont({x}, {cuts})) FROM {t}), lambda c: {x} > c))"


def information_sql(x, y, t):
    """Mutual information in nats of two discrete expressions."""
    return f"""(WITH p AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {t} GROUP BY ALL), a AS (SELECT x, sum(n) AS nx FROM p GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM p GROUP BY 1), w AS (SELECT sum(n) AS w FROM p)
SELECT greatest(0, sum(n / w * ln(n * w / (nx * ny)))) FROM p JOIN a USING (x) JOIN b USING (y), w)"""


def eta_sql(x, g, t):
    return f"(WITH m AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS m FROM {t} GROUP BY 1), w AS (SELECT avg({x}) AS m, var_pop({x}) * count(*) AS q FROM {t}) SELECT sqrt(sum(n * (m.m - w.m) * (m.m - w.m)) / any_value(q)) FROM m, w)"


def f_sql(x, g, t):
    return f"(WITH m AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS m, var_pop({x}) * count(*) AS q FROM {t} GROUP BY 1), w AS (SELECT avg({x}) AS m FROM {t}) SELECT (sum(n * (m.m - w.m) * (m.m - w.m)) / (count(*) - 1)) / (sum(q) / (sum(n) - count(*))) FROM m, w)"


def cramers_sql(x, g, t):
    return f"""(WITH p AS (SELECT {x} AS x, {g} AS g, count(*) AS o FROM {t} GROUP BY ALL), a AS (SELECT x, sum(o) AS nx FROM p GROUP BY 1), b AS (SELECT g, sum(o) AS ng FROM p GROUP BY 1), w AS (SELECT sum(o) AS n FROM p),
c AS (SELECT nx * ng / n AS e, coalesce(o, 0) AS o FROM a CROSS JOIN b CROSS JOIN w LEFT JOIN p ON p.x = a.x AND p.g = b.g) SELECT sqrt(sum((o - e) * (o - e) / e) / (any_value(n) * (least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) - 1))) FROM c, w)"""


def psi_sql(x):
    cuts = "[" + ", ".join(repr(k / 10) for k in range(1, 10)) + "]"
    return f"""(WITH c AS (SELECT list_distinct(quantile_cont({x}, {cuts})) AS c FROM {TRAIN}), a AS (SELECT len(list_filter(c, lambda v: {x} > v)) AS k, count(*) * 1.0 / (SELECT count(*) FROM {TRAIN}) AS p FROM {TRAIN}, c GROUP BY 1), b AS (SELECT len(list_filter(c, lambda v: {x} > v)) AS k, count(*) * 1.0 / (SELECT count(*) FROM {TEST}) AS q FROM {TEST}, c GROUP BY 1),
j AS (SELECT greatest(coalesce(p, 0), 1e-4) AS p, greatest(coalesce(q, 0), 1e-4) AS q FROM c, range(len(c) + 1) r(k) LEFT JOIN a ON a.k = r.k LEFT JOIN b ON b.k = r.k) SELECT sum((q - p) * ln(q / p)) FROM j)"""


def ks_sql(x):
    return f"""(WITH u AS (SELECT {x} AS x, 1 AS a, 0 AS b FROM {TRAIN} UNION ALL SELECT {x}, 0, 1 FROM {TEST}), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1)
SELECT max(gap) FROM (SELECT abs(sum(a) OVER w / (SELECT count(*) FROM {TRAIN}) - sum(b) OVER w / (SELECT count(*) FROM {TEST})) AS gap FROM c WINDOW w AS (ORDER BY x)))"""


def drift_sql(x):
    facts = {"mean": "avg({x})", "std": "stddev_samp({x})", "p1": "quantile_cont({x}, 0.01)", "median": "quantile_cont({x}, 0.5)", "p99": "quantile_cont({x}, 0.99)", "min": "min({x})", "max": "max({x})"}
    side = lambda t, s: f"(SELECT {', '.join(f'{v.format(x=x)} AS {k}_{s}' for k, v in facts.items())} FROM {t}) {s}"
    far = f"(SELECT 100.0 * avg(CAST({x} < p1_train AS INTEGER)) AS below, 100.0 * avg(CAST({x} > p99_train AS INTEGER)) AS above, 100.0 * avg(CAST({x} < min_train OR {x} > max_train AS INTEGER)) AS outside FROM {TEST}, {side(TRAIN, 'train')}) far"
    named = ", ".join(f"{r4(f'{k}_{s}')} AS {k}_{s}" for s in ("train", "test") for k in facts)
    return f"""WITH d AS (SELECT *, (mean_test - mean_train) / sqrt((std_train * std_train + std_test * std_test) / 2) AS smd, {ks_sql(x)} AS ks, {psi_sql(x)} AS psi FROM {side(TRAIN, 'train')}, {side(TEST, 'test')}, {far})
SELECT '{x}' AS "column", CAST(NULL AS VARCHAR) AS skipped, {named}, {r4('smd')} AS smd, {r4('ks')} AS ks, {r4('psi')} AS psi, {r4('below')} AS pct_test_below_train_p1, {r4('above')} AS pct_test_above_train_p99, {r4('outside')} AS pct_test_outside_train_range,
CASE WHEN psi >= 0.25 OR abs(smd) >= 0.5 OR ks >= 0.2 OR outside >= 5 THEN 'high' WHEN psi >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM d"""


KENDALL_SQL = f"""WITH s AS (SELECT sum(sign(a.p_size - b.p_size) * sign(a.p_partkey - b.p_partkey)) AS s, sum(CAST(a.p_size <> b.p_size AS BIGINT)) AS x, sum(CAST(a.p_partkey <> b.p_partkey AS BIGINT)) AS y FROM part a, part b) SELECT {r4("s / sqrt(x * 1.0 * y)")} AS tau FROM s"""


# -- the first slice: filter, scale, group statistics ------------------------------------------


@query(f"""
WITH f AS (SELECT {LINE}, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 10),
s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM f),
g AS (SELECT l_returnflag, avg((l_quantity - m) / s) AS mean FROM f, s GROUP BY 1)
SELECT {LINE}, {r4("(l_quantity - m) / s")} AS l_quantity, f.l_returnflag, {r4("g.mean")} AS l_quantity_mean_by_l_returnflag
FROM f CROSS JOIN s JOIN g ON f.l_returnflag = g.l_returnflag""")
def workspace_slice(spark, d):
    df = lineitem(spark, d, *LINE_COLUMNS, "l_quantity", "l_returnflag")
    df = step(df, "filter_rows", conditions=[{"column": "l_quantity", "op": "ge", "value": 10}])
    df = step(df, "scale", columns=["l_quantity"])
    df = step(df, "group_agg", group="l_returnflag", value="l_quantity", aggs=["mean"])
    return rounded(df, "l_extendedprice")


# -- columns ----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, d):
    return step(table(spark, d, "customer"), "drop_columns", columns=["c_acctbal", "absent"], missing_ok=True)


@query("SELECT c_mktsegment, c_custkey FROM customer")
def select_columns(spark, d):
    return step(table(spark, d, "customer"), "select_columns", columns=["c_mktsegment", "c_custkey"])


@query("SELECT c_custkey, c_acctbal, c_name, c_nationkey, c_mktsegment FROM customer")
def reorder_columns(spark, d):
    return step(table(spark, d, "customer"), "reorder_columns", columns=["c_acctbal"], position="after", anchor="c_custkey")


@query("SELECT p_partkey, p_size, p_size AS size_copy FROM part")
def copy_column(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_size"), "copy_column", column="p_size", name="size_copy")


@query("SELECT c_custkey, c_name AS c_mktsegment, c_mktsegment AS c_name FROM customer")
def rename(spark, d):
    return step(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "rename", mapping={"c_name": "c_mktsegment", "c_mktsegment": "c_name"})


@query('SELECT p_partkey AS "x_P_PARTKEY", p_brand AS "x_P_BRAND" FROM part')
def rename_columns_bulk(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_brand"), "rename_columns_bulk", rule="upper", prefix="x_")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS VARCHAR) AS p_name FROM part")
def cast(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_partkey").alias("p_name"))
    return step(df, "cast", dtypes={"p_size": "float64", "p_name": "str"})


@query("SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders")
def parse_dates(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return step(df, "parse_dates", columns=["day"], format="%d/%m/%Y")


# -- rows -------------------------------------------------------------------------------------


@query(f"SELECT {LINE} FROM lineitem WHERE l_quantity > 30 AND l_returnflag <> 'N' AND l_linenumber IN (1, 3)")
def filter_and(spark, d):
    c = [{"column": "l_quantity", "op": "gt", "value": 30}, {"column": "l_returnflag", "op": "ne", "value": "N"}, {"column": "l_linenumber", "op": "isin", "value": [1, 3, "x"]}]
    return step(table(spark, d, "lineitem"), "filter_rows", conditions=c).select(*LINE_COLUMNS)


@query(f"SELECT event_id, value FROM {GAPS} WHERE value IS NULL OR value NOT BETWEEN 10 AND 50")
def filter_or(spark, d):
    c = [{"column": "value", "op": "isna"}, {"column": "value", "op": "lt", "value": 10}, {"column": "value", "op": "gt", "value": 50}]
    return step(gaps(spark, d), "filter_rows", conditions=c, combine="or").select("event_id", "value")


@query(f"SELECT event_id FROM {GAPS} WHERE value IS NULL OR value <> 1.0")
def filter_missing_semantics(spark, d):
    return step(gaps(spark, d), "filter_rows", conditions=[{"column": "value", "op": "notin", "value": [1.0]}]).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def page_rows(spark, d):
    df = step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "sort_rows", by=["o_totalprice", "o_orderkey"], ascending=[False, True])
    return df.offset(100).limit(50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def sample_head(spark, d):
    df = table(spark, d, "orders").withColumn("_rid", F.col("o_orderkey"))
    return step(df, "sample_rows", mode="head", n=100).select("o_orderkey")


@query()
def sample_random(spark, d):
    df = table(spark, d, "orders").withColumn("_rid", F.col("o_orderkey"))
    return step(df, "sample_rows", frac=0.1, random_state=7).select("o_orderkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_last(spark, d):
    df = table(spark, d, "events").withColumn("_rid", F.col("event_id"))
    return step(df, "drop_duplicates", subset=["user_id", "event_type"], keep="last", sort_by=["ts"]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)")
def dedupe_none(spark, d):
    return step(table(spark, d, "documents"), "drop_duplicates", subset=["text"], keep="none").select("doc_id")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def drop_missing_target(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")
    return step(df, "drop_missing_target", target="quality")


@query("SELECT doc_id, lang FROM documents")
def drop_high_missing(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "toxic")
    return step(df, "drop_high_missing", threshold=0.5)


# -- text -------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN t = 'small' THEN 'S' ELSE t END AS p_type FROM (SELECT p_partkey, lower(trim(regexp_replace(p_type, '[-_. ]+', ' ', 'g'))) AS t FROM part)")
def standardize_text(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_type"), "standardize_text", columns=["p_type"], lower=True, unify_separators=True, mapping={"small": "S"})


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) + 0.5 AS money FROM customer")
def to_numeric(spark, d):
    text = F.concat(F.lit("€ "), F.format_string("%,d", F.col("c_custkey")), F.lit(".50 EUR"))
    return step(table(spark, d, "customer").select("c_custkey", text.alias("money")), "to_numeric", columns=["money"], thousands=",")


@query(r"SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/?#]+)', 1), '') AS url_scheme, nullif(regexp_extract(url, '^(https?)://([^/?#]+)', 2), '') AS url_host FROM pages")
def extract(spark, d):
    return step(table(spark, d, "pages").select("page_id", "url"), "extract", column="url", pattern=r"^(?P<scheme>https?)://(?P<host>[^/?#]+)").drop("url")


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN NULL ELSE p_size END AS p_size FROM part")
def replace_sentinels(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_size"), "replace_sentinels", sentinels={"p_size": [1, 2, "N/A"]})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'O' WHEN 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_values(spark, d):
    return step(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "replace_values", mapping={"o_orderstatus": {"O": "F", "F": "O", "P": None}})


# -- fitted numbers ---------------------------------------------------------------------------


@query("SELECT o_orderkey, least(greatest(o_totalprice, a), b) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders)")
def clip(spark, d):
    return step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "clip", columns=["o_totalprice"])


def scaled(spark, d, method):
    return rounded(step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "scale", columns=["o_totalprice"], method=method))


def scale_sql(center, spread):
    return f"SELECT o_orderkey, {r4('(o_totalprice - c) / s')} AS o_totalprice FROM orders, (SELECT {center} AS c, {spread} AS s FROM orders)"


@query(scale_sql("avg(o_totalprice)", "stddev_pop(o_totalprice)"))
def scale_standard(spark, d):
    return scaled(spark, d, "standard")


@query(scale_sql("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"))
def scale_minmax(spark, d):
    return scaled(spark, d, "minmax")


@query(scale_sql("median(o_totalprice)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"))
def scale_robust(spark, d):
    return scaled(spark, d, "robust")


@query(scale_sql("0", "max(abs(o_totalprice))"))
def scale_maxabs(spark, d):
    return scaled(spark, d, "maxabs")


@query(f"SELECT o_orderkey, {r4('ln(1 + o_totalprice)')} AS o_totalprice FROM orders")
def log1p(spark, d):
    return rounded(step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "log1p", columns=["o_totalprice"]))


@query(f"SELECT o_orderkey, {r4('o_totalprice + (SELECT avg(o_totalprice) FROM ' + TRAIN + ') - (SELECT avg(o_totalprice) FROM ' + TEST + ')')} AS o_totalprice FROM {TEST}")
def align_shift_mean(spark, d):
    train, test = (x.select("o_orderkey", "o_totalprice") for x in sides(spark, d))
    op, p = get("align_to_train"), {"columns": ["o_totalprice"]}
    return rounded(op.apply(test, p, op.fit(train, p)))


@query(f"""WITH a AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS i FROM {TRAIN}),
b AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS i FROM {TEST})
SELECT o_orderkey, {r4("(o_totalprice - b.m) * (a.i / b.i) + a.m")} AS o_totalprice FROM {TEST}, a, b""")
def align_robust(spark, d):
    train, test = (x.select("o_orderkey", "o_totalprice") for x in sides(spark, d))
    op, p = get("align_to_train"), {"columns": ["o_totalprice"], "mode": "robust"}
    return rounded(op.apply(test, p, op.fit(train, p)))


@query(ALIGN_SQL)
def align_quantile(spark, d):
    train, test = (x.select("o_orderkey", "o_totalprice") for x in sides(spark, d))
    op, p = get("align_to_train"), {"columns": ["o_totalprice"], "mode": "quantile", "n_quantiles": 20}
    return rounded(op.apply(test, p, op.fit(train, p)))


GROUP_ALIGN_SQL = f"""WITH a AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM {TRAIN} GROUP BY 1), b AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM {TEST} GROUP BY 1)
SELECT o_orderkey, o_orderstatus, {r4("(o_totalprice - b.m) * a.s / b.s + a.m")} AS o_totalprice FROM {TEST} t JOIN a ON a.g = o_orderstatus JOIN b ON b.g = o_orderstatus"""


@query(GROUP_ALIGN_SQL)
def align_group(spark, d):
    train, test = (x.select("o_orderkey", "o_orderstatus", "o_totalprice") for x in sides(spark, d))
    op, p = get("align_to_train"), {"columns": ["o_totalprice"], "mode": "standardize", "group": "o_orderstatus"}
    return rounded(op.apply(test, p, op.fit(train, p)))


@query(f"""WITH g AS (SELECT o_orderstatus AS g, quantile_cont(o_totalprice, {shares_sql(20)}) AS q FROM {TRAIN} GROUP BY 1),
t AS (SELECT o_orderkey, o_orderstatus, (rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY o_orderstatus) - 1) * 19 AS place FROM {TEST})
SELECT o_orderkey, o_orderstatus, {r4(grid_sql("", "q", "place"))} AS o_totalprice FROM t JOIN g ON g = o_orderstatus""")
def align_group_quantile(spark, d):
    train, test = (x.select("o_orderkey", "o_orderstatus", "o_totalprice") for x in sides(spark, d))
    op, p = get("align_to_train"), {"columns": ["o_totalprice"], "mode": "quantile", "group": "o_orderstatus", "n_quantiles": 20}
    return rounded(op.apply(test, p, op.fit(train, p)))


@query(power_sql())
def power_transform(spark, d):
    return rounded(step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "power_transform", columns=["o_totalprice"]))


@query(QUANTILE_SQL)
def quantile_transform(spark, d):
    return rounded(step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "quantile_transform", columns=["o_totalprice"], output_distribution="normal"))


@query(spline_sql())
def spline(spark, d):
    return rounded(step(table(spark, d, "part").select("p_partkey", "p_retailprice"), "spline", columns=["p_retailprice"]))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_size * CAST(p_size AS DOUBLE) AS \"p_size^2\", p_size * p_retailprice AS \"p_size*p_retailprice\", p_retailprice * p_retailprice AS \"p_retailprice^2\" FROM part")
def polynomial(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "polynomial", columns=["p_size", "p_retailprice"])


@query("SELECT p_partkey, p_size, p_retailprice, p_size * p_retailprice AS \"p_size*p_retailprice\" FROM part")
def interactions(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "interactions", columns=["p_size", "p_retailprice"])


@query(pca_sql())
def pca(spark, d):
    df = lineitem(spark, d, *LINE_COLUMNS[:4], "l_quantity", "l_discount", "l_tax")
    return rounded(step(df, "pca", columns=["l_quantity", "l_discount", "l_tax"], n_components=2))


# -- features ---------------------------------------------------------------------------------


@query(f"SELECT {LINE}, l_extendedprice / CASE WHEN abs(l_discount) >= 0.01 THEN l_discount ELSE 0.01 END AS ratio FROM lineitem")
def derive_ratio(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS, "l_discount"), "derive", a="l_extendedprice", b="l_discount", op="ratio", name="ratio", min_denominator=0.01).drop("l_discount")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS days FROM events")
def derive_days_between(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", F.lit("2024-01-01").alias("start"))
    return step(df, "derive", a="ts", b="start", op="days_between", name="days").select("event_id", "days")


@query("SELECT event_id, hour(ts) AS ts_hour, isodow(ts) - 1 AS ts_dayofweek, month(ts) AS ts_month, year(ts) AS ts_year, CAST(isodow(ts) >= 6 AS BIGINT) AS ts_is_weekend FROM events")
def datetime_parts(spark, d):
    return step(table(spark, d, "events").select("event_id", "ts"), "datetime_parts", column="ts").drop("ts")


@query(f"SELECT p_partkey, {r4('sin(p_size * (2 * pi() / 50))')} AS p_size_sin, {r4('cos(p_size * (2 * pi() / 50))')} AS p_size_cos FROM part")
def cyclical(spark, d):
    return rounded(step(table(spark, d, "part").select("p_partkey", "p_size"), "cyclical", column="p_size", period=50).drop("p_size"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'low' WHEN p_size > 10 AND p_size <= 40 THEN 'mid' END AS size_bin FROM part")
def bin_cut(spark, d):
    return step(table(spark, d, "part").select("p_partkey", "p_size"), "bin", column="p_size", edges=[0, 10, 40], labels=["low", "mid"], name="size_bin").drop("p_size")


@query("SELECT o_orderkey, CAST(o_totalprice > a AS BIGINT) + CAST(o_totalprice > b AS BIGINT) + CAST(o_totalprice > c AS BIGINT) AS price_bin FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)")
def bin_qcut(spark, d):
    return step(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "bin", column="o_totalprice", mode="qcut", q=4, name="price_bin").drop("o_totalprice")


@query(f"""WITH g AS (SELECT user_id, {r4('avg(value)')} AS m, {r4('stddev_samp(value)')} AS s, count(value) AS c, median(value) AS d, min(value) AS a, max(value) AS b FROM events GROUP BY 1),
o AS (SELECT user_id, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM events GROUP BY 1)
SELECT event_id, m AS value_mean_by_user_id, s AS value_std_by_user_id, c AS value_count_by_user_id, {r4('d')} AS value_median_by_user_id, a AS value_min_by_user_id, b AS value_max_by_user_id, f AS value_first_by_user_id, l AS value_last_by_user_id
FROM events JOIN g USING (user_id) JOIN o USING (user_id)""")
def group_agg(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = step(df, "group_agg", group="user_id", value="value", aggs=["mean", "std", "count", "median", "min", "max", "first", "last"], order="ts").drop("user_id", "ts", "value")
    return rounded(out, *[f"value_{a}_by_user_id" for a in ("min", "max", "first", "last")])


# -- formulas ---------------------------------------------------------------------------------


@query(f"SELECT {LINE}, l_extendedprice * (1 - l_discount) + l_tax / 2 AS x FROM lineitem")
def formula_arith(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS, "l_discount", "l_tax"), "formula", name="x", expr="l_extendedprice * (1 - l_discount) + l_tax / 2").drop("l_discount", "l_tax")


@query(f"SELECT {LINE}, CASE WHEN l_returnflag = 'R' THEN floor(l_quantity / 7) ELSE l_quantity - 7 * floor(l_quantity / 7) END AS x FROM lineitem")
def formula_where(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS, "l_quantity", "l_returnflag"), "formula", name="x", expr="l_quantity // 7 if l_returnflag == 'R' else l_quantity % 7").drop("l_quantity", "l_returnflag")


@query(f"SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE CAST(value > 10 OR value < 5 AS DOUBLE) END AS x FROM {GAPS}")
def formula_missing_logic(spark, d):
    return step(gaps(spark, d).select("event_id", "value"), "formula", name="x", expr="value > 10 or not value >= 5").drop("value")


@query(f"SELECT event_id, value - last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM {GAPS}")
def formula_group_prev(spark, d):
    df = gaps(spark, d).withColumn("_rid", F.col("event_id"))
    return step(df, "formula", name="x", expr="value - group_prev(value, by=user_id, order=ts)").select("event_id", "x")


@query(f"SELECT event_id, {r4('(value - m) / (b - a)')} AS x FROM {GAPS}, (SELECT median(value) AS m, min(value) AS a, max(value) AS b FROM {GAPS})")
def formula_variables(spark, d):
    v = [{"name": n, "stat": s, "column": "value"} for n, s in (("m", "median"), ("a", "min"), ("b", "max"))]
    return rounded(step(gaps(spark, d).select("event_id", "value"), "formula", name="x", expr="(value - @m) / (@b - @a)", variables=v).drop("value"))


@query(f"""SELECT 'double' AS name, count(value) AS count, count(*) - count(value) AS missing, {r4('avg(value * 2)')} AS mean, {r4('stddev_pop(value * 2)')} AS std, {r4('min(value * 2)')} AS min, {r4('quantile_cont(value * 2, 0.25)')} AS q25, {r4('median(value * 2)')} AS median, {r4('quantile_cont(value * 2, 0.75)')} AS q75, {r4('max(value * 2)')} AS max, {r4('sum(value * 2)')} AS sum FROM {GAPS}""")
def evaluate_expressions(spark, d):
    return rounded(evaluate(gaps(spark, d), {"double": "value * 2"}))


# -- imputation -------------------------------------------------------------------------------


def imputed(spark, d, **p):
    df = gaps(spark, d).withColumn("_rid", F.col("event_id"))
    return step(df, "impute", columns=["value"], **p).select("event_id", "value", *(["value_was_missing"] if p.get("add_indicator") else []))


@query(f"SELECT event_id, coalesce(value, (SELECT median(value) FROM {GAPS})) AS value, CAST(value IS NULL AS INTEGER) AS value_was_missing FROM {GAPS}")
def impute_median(spark, d):
    return imputed(spark, d, add_indicator=True)


@query(f"SELECT event_id, {r4(f'coalesce(value, (SELECT avg(value) FROM {GAPS}))')} AS value FROM {GAPS}")
def impute_mean(spark, d):
    return rounded(imputed(spark, d, strategy="mean"))


@query(f"SELECT event_id, coalesce(value, (SELECT value FROM {GAPS} WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS value FROM {GAPS}")
def impute_mode(spark, d):
    return imputed(spark, d, strategy="most_frequent")


@query(f"SELECT event_id, coalesce(value, -1.5) AS value FROM {GAPS}")
def impute_constant(spark, d):
    return imputed(spark, d, strategy="constant", fill_value=-1.5)


@query(f"SELECT event_id, coalesce(value, user_id * 2.0) AS value FROM {GAPS}")
def impute_formula(spark, d):
    return imputed(spark, d, strategy="formula", expr="user_id * 2")


@query(f"SELECT event_id, {r4('coalesce(value, avg(value) OVER (PARTITION BY user_id))')} AS value FROM {GAPS}")
def impute_group_mean(spark, d):
    return rounded(imputed(spark, d, strategy="group_mean", by="user_id"))


@query(f"SELECT event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT median(value) FROM {GAPS})) AS value FROM {GAPS}")
def impute_group_prev(spark, d):
    return imputed(spark, d, strategy="group_prev", by="user_id", order="ts", fallback="median")


@query(f"""WITH e AS (SELECT event_id, value, CAST(epoch_us(ts) AS DOUBLE) AS o,
 last_value(CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END IGNORE NULLS) OVER b AS oa, last_value(value IGNORE NULLS) OVER b AS va,
 first_value(CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END IGNORE NULLS) OVER f AS ob, first_value(value IGNORE NULLS) OVER f AS vb
 FROM {GAPS} WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, {r4("coalesce(value, va + (vb - va) * CASE WHEN ob - oa > 0 THEN (o - oa) / (ob - oa) ELSE 0.5 END)")} AS value FROM e""")
def impute_group_interp(spark, d):
    return rounded(imputed(spark, d, strategy="group_interp", by="user_id", order="ts"))


@query(f"""SELECT event_id, coalesce(value, CASE WHEN n - sn <= 1 THEN sv END) AS value FROM (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER w AS sn, last_value(value IGNORE NULLS) OVER w AS sv
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {GAPS}) WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def ffill_limit(spark, d):
    df = gaps(spark, d).withColumn("_rid", F.col("event_id"))
    return step(df, "ffill", sort_by="ts", columns=["value"], by="user_id", limit=1).select("event_id", "value")


@query()
def impute_knn(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END").alias("p_size"), "p_retailprice")
    return step(df, "impute_knn", columns=["p_size", "p_retailprice"])


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END AS n FROM customer),
d AS (SELECT a.c_custkey, b.n, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal)) AS k FROM c a JOIN c b ON a.n IS NULL AND b.n IS NOT NULL)
SELECT c_custkey, c_acctbal, {r4("coalesce(n, (SELECT avg(d.n) FROM d WHERE d.c_custkey = c.c_custkey AND k <= 5))")} AS c_nationkey FROM c""")
def impute_knn_one(spark, d):
    """With one other column, the nearest rows are those of the nearest values."""
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.expr("CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END").alias("c_nationkey"))
    return rounded(step(df, "impute_knn", columns=["c_nationkey", "c_acctbal"]), "c_acctbal")


@query("""WITH p AS (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 9 > 0 THEN p_size END AS s FROM part), f AS (SELECT regr_slope(s, p_retailprice) AS b, regr_intercept(s, p_retailprice) AS a FROM p)
SELECT p_partkey, floor(coalesce(s, a + b * p_retailprice) * 100 + 0.5) / 100 AS p_size, p_retailprice FROM p, f""")
def impute_iterative(spark, d):
    """One column with missing values beside a whole one: its regression on that."""
    df = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END").alias("p_size"), "p_retailprice")
    return step(df, "impute_iterative", columns=["p_size", "p_retailprice"], max_iter=3).withColumn("p_size", F.floor(F.col("p_size") * 100 + 0.5) / 100)


# -- encoding and selection -------------------------------------------------------------------


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{v}' AS INTEGER) AS \"c_mktsegment_{v}\"" for v in SEGMENTS) + " FROM customer")
def onehot(spark, d):
    return step(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "onehot", columns=["c_mktsegment"])


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\", 0 AS o_orderstatus_missing FROM orders")
def onehot_status(spark, d):
    return step(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "onehot", columns=["o_orderstatus"], missing=True)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE -1 END::BIGINT AS o_orderstatus FROM orders")
def ordinal(spark, d):
    return step(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "ordinal", categories={"o_orderstatus": ["P", "O"]})


@query(f"SELECT {LINE}, l_quantity FROM lineitem")
def drop_low_variance(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS, "l_quantity", "l_discount"), "drop_low_variance", threshold=0.01)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def drop_correlated(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2 + 1).alias("twice"))
    return step(df, "drop_correlated", columns=["o_totalprice", "twice"], threshold=0.9)


BEST = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {kept}, l_returnflag FROM lineitem WHERE {better}"


@query(BEST.format(kept="l_quantity, l_discount", better=" AND ".join(f"{f_sql(c, 'l_returnflag', 'lineitem')} > {f_sql('l_tax', 'l_returnflag', 'lineitem')}" for c in ("l_quantity", "l_discount"))))
def select_k_best_f(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS[:4], "l_quantity", "l_discount", "l_tax", "l_returnflag"), "select_k_best", target="l_returnflag", score="f_test", k=2, columns=["l_quantity", "l_discount", "l_tax"])


@query(BEST.format(kept="l_quantity", better=" AND ".join(f"{information_sql(bins_sql('l_quantity', 'lineitem'), 'l_returnflag', 'lineitem')} > {information_sql(bins_sql(c, 'lineitem'), 'l_returnflag', 'lineitem')}" for c in ("l_discount", "l_tax"))))
def select_k_best_mi(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS[:4], "l_quantity", "l_discount", "l_tax", "l_returnflag"), "select_k_best", target="l_returnflag", k=1, columns=["l_quantity", "l_discount", "l_tax"])


@query()
def select_from_model(spark, d):
    return step(lineitem(spark, d, *LINE_COLUMNS[:4], "l_quantity", "l_discount", "l_tax", "l_returnflag"), "select_from_model", target="l_returnflag", model="tree", columns=["l_quantity", "l_discount", "l_tax"])


@query("""SELECT 'min' AS rule, 'o_totalprice' AS "column", count(*) AS count FROM orders WHERE o_totalprice < 5000 HAVING count(*) > 0
UNION ALL SELECT 'allowed', 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') HAVING count(*) > 0
UNION ALL SELECT 'required', 'absent', 1
UNION ALL SELECT 'unique', 'o_custkey', count(o_custkey) - count(DISTINCT o_custkey) FROM orders HAVING count(o_custkey) > count(DISTINCT o_custkey)""")
def expected_schema(spark, d):
    rules = [{"name": "o_totalprice", "min": 5000}, {"name": "o_orderstatus", "allowed": ["O", "F"]}, {"name": "absent"}, {"name": "o_custkey", "unique": True, "nullable": False}, {"name": "o_orderdate", "dtype": "datetime"}]
    return findings_frame(table(spark, d, "orders"), {"columns": rules}).drop("examples")


# -- profiles ---------------------------------------------------------------------------------


@query("""SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS missing, count(DISTINCT o_orderkey) AS n_unique, count(*) AS rows FROM orders
UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(DISTINCT o_custkey), count(*) FROM orders UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), count(*) FROM orders
UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), count(DISTINCT o_totalprice), count(*) FROM orders UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), count(DISTINCT o_orderdate), count(*) FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), count(*) FROM orders""")
def column_profile(spark, d):
    return profile.column_profile(table(spark, d, "orders"), exact=True).select("column", "missing", "n_unique", "rows")


def stats_sql(c, t):
    q = {"p1": 0.01, "p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    return f"""(WITH s AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, avg({c}) AS m, stddev_samp({c}) AS s FROM {t})
SELECT '{c}' AS "column", count({c}) AS count, {r4(f"avg({c})")} AS mean, {r4(f"stddev_samp({c})")} AS std, min({c}) AS min, max({c}) AS max, {", ".join(f"{r4(f'quantile_cont({c}, {v})')} AS {k}" for k, v in q.items())},
{r4(f"skewness({c})")} AS skew, {r4(f"kurtosis({c})")} AS kurtosis, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives,
count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS iqr_outliers, count(*) FILTER (abs({c} - m) > 3 * s) AS z_outliers FROM {t}, s)"""


@query(stats_sql("l_quantity", "lineitem") + " UNION ALL " + stats_sql("l_extendedprice", "lineitem"))
def numeric_stats(spark, d):
    return rounded(profile.numeric_stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "min", "max")


@query("""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), c AS (SELECT least(CAST(floor((o_totalprice - a) / ((b - a) / 30)) AS BIGINT), 29) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT g AS bin, coalesce(n, 0) AS count FROM range(30) t(g) LEFT JOIN c ON g = bin""")
def histogram(spark, d):
    return profile.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "count")


@query(f"SELECT o_orderpriority AS value, count(*) AS count, {r4('100.0 * count(*) / (SELECT count(*) FROM orders)')} AS pct FROM orders GROUP BY 1")
def category_values(spark, d):
    return rounded(profile.category_values(table(spark, d, "orders"), "o_orderpriority"))


@query("SELECT count(ts) AS count, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS min, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS max, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS span_days FROM events")
def datetime_stats(spark, d):
    return profile.datetime_stats(table(spark, d, "events"), "ts")


@query(f"SELECT count(DISTINCT text) AS \"distinct\", {r4('avg(length(text))')} AS mean_length, min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents")
def text_stats(spark, d):
    return rounded(profile.text_stats(table(spark, d, "documents"), "text"))


@query("SELECT count(DISTINCT o_custkey) AS \"distinct\", count(o_custkey) - count(DISTINCT o_custkey) AS duplicates FROM orders")
def id_stats(spark, d):
    return profile.id_stats(table(spark, d, "orders"), "o_custkey")


# -- cleanliness ------------------------------------------------------------------------------


def labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def rate_sql(c):
    return f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {r4(f'100.0 * (count(*) - count({c})) / count(*)')} AS rate FROM {LABELLED}"


@query(" UNION ALL ".join(map(rate_sql, ("doc_id", "lang", "quality", "toxic"))))
def missing_rates(spark, d):
    return rounded(cleanliness.missing_rates(labelled(spark, d)).drop("advice"))


@query(f"SELECT g AS missing, coalesce(n, 0) AS rows FROM range(5) t(g) LEFT JOIN (SELECT CAST(doc_id IS NULL AS BIGINT) + CAST(lang IS NULL AS BIGINT) + CAST(quality IS NULL AS BIGINT) + CAST(toxic IS NULL AS BIGINT) AS k, count(*) AS n FROM {LABELLED} GROUP BY 1) ON g = k")
def missing_per_row(spark, d):
    return cleanliness.missing_per_row(labelled(spark, d)).drop("spike")


@query("SELECT 'quality' AS a, 'toxic' AS b, 1.0::DOUBLE AS jaccard")
def missing_cooccurrence(spark, d):
    return cleanliness.cooccurrence(labelled(spark, d))


@query("SELECT 'city' AS \"column\", 'n/a' AS token, count(*) AS count FROM part WHERE p_partkey % 5 = 0")
def sentinel_counts(spark, d):
    df = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' N/A ' ELSE p_brand END").alias("city"), F.col("p_size").alias("size"))
    return cleanliness.sentinel_counts(df)


def outlier_sql(c, t):
    return f"""(WITH s AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, avg({c}) AS m, stddev_samp({c}) AS s, median({c}) AS d FROM {t}), k AS (SELECT median(abs({c} - d)) AS mad FROM {t}, s)
SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n_iqr, count(*) FILTER (abs({c} - m) > 3 * s) AS n_z, count(*) FILTER (0.6745 * abs({c} - d) / nullif(mad, 0) > 3.5) AS n_mad FROM {t}, s, k)"""


@query(outlier_sql("value", "events") + " UNION ALL " + outlier_sql("user_id", "events"))
def outliers(spark, d):
    return cleanliness.univariate_outliers(table(spark, d, "events"), ["value", "user_id"])


@query(f"""WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s)
SELECT 'value' AS "column", {r4('any_value(q1)')} AS q1, {r4('any_value(m)')} AS median, {r4('any_value(q3)')} AS q3, {r4('any_value(lo)')} AS low_fence, {r4('any_value(hi)')} AS high_fence, {r4('min(value) FILTER (value BETWEEN lo AND hi)')} AS low_whisker, {r4('max(value) FILTER (value BETWEEN lo AND hi)')} AS high_whisker, count(*) FILTER (value < lo) AS below, count(*) FILTER (value > hi) AS above FROM events, f""")
def box_stats(spark, d):
    return rounded(cleanliness.box_stats(table(spark, d, "events"), ["value"]))


@query()
def isolation_forest(spark, d):
    return cleanliness.isolation_scores(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey").orderBy(F.desc("score"), "o_orderkey").limit(20)


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS redundant, CAST(sum(n) AS BIGINT) AS involved, count(*) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def exact_duplicates(spark, d):
    return cleanliness.exact_duplicates(table(spark, d, "documents"), ["text"])


@query("""WITH g AS (SELECT text, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
SELECT doc_id, (SELECT count(*) FROM g h WHERE h.f <= g.f) AS "group" FROM documents JOIN g USING (text)""")
def duplicate_groups(spark, d):
    return cleanliness.duplicate_groups(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "group")


@query("""SELECT 'lang' AS "column", count(*) FILTER (a > 1) AS keys FROM (SELECT count(DISTINCT lang) AS a FROM documents GROUP BY source HAVING count(*) > 1)""")
def conflicts(spark, d):
    return cleanliness.conflicts(table(spark, d, "documents").select("source", "lang"), "source")


@query("""WITH v AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN ' ' || lower(p_type) ELSE p_type END AS value, p_partkey FROM part), c AS (SELECT value, count(*) AS n, min(p_partkey) AS f, lower(trim(regexp_replace(value, '[-_. ]+', ' ', 'g'))) AS form FROM v GROUP BY value)
SELECT value, first_value(value) OVER (PARTITION BY form ORDER BY n DESC, f, value) AS canonical, n AS count FROM c QUALIFY count(*) OVER (PARTITION BY form) > 1""")
def spelling_variants(spark, d):
    value = F.expr("CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN ' ' || lower(p_type) ELSE p_type END")
    return cleanliness.variants(table(spark, d, "part").select("p_partkey", value.alias("value")), "value", "p_partkey")


DATES = "CASE o_orderkey % 2 WHEN 0 THEN {iso} ELSE {dmy} END"


@query("""SELECT CASE WHEN k = 0 THEN 'YYYY-MM-DD' WHEN dd > 12 THEN 'DD/MM' WHEN mm > 12 THEN 'MM/DD' ELSE '??/??' END AS format, count(*) AS count FROM (SELECT o_orderkey % 2 AS k, day(o_orderdate) AS dd, month(o_orderdate) AS mm FROM orders) GROUP BY 1""")
def date_formats(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return cleanliness.date_formats(table(spark, d, "orders").select(text.alias("day")), "day")


@query("SELECT count(*) AS dates, count(*) FILTER (day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) AS ambiguous FROM orders")
def ambiguous_dates(spark, d):
    return cleanliness.ambiguous_dates(table(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")), "day")


# -- relations --------------------------------------------------------------------------------


def corr_sql(*pairs):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r4(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in pairs)


@query(corr_sql(("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")))
def corr_pearson(spark, d):
    return rounded(relations.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"SELECT {r4('corr(x, y)')} AS corr FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)")
def corr_spearman(spark, d):
    return rounded(relations.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query(KENDALL_SQL)
def corr_kendall(spark, d):
    tau = relations.kendall(table(spark, d, "part"), "p_size", "p_partkey")
    return rounded(spark.createDataFrame([(tau,)], "tau double"))


@query("""WITH g AS (SELECT DISTINCT l_returnflag AS "group" FROM lineitem), b AS (SELECT * FROM range(5) t(bin)), c AS (SELECT l_returnflag AS "group", least(CAST(floor(l_quantity / 10) AS BIGINT), 4) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2)
SELECT g."group", b.bin, coalesce(n, 0) AS count FROM g CROSS JOIN b LEFT JOIN c ON c."group" = g."group" AND c.bin = b.bin""")
def distribution_numeric(spark, d):
    return relations.numeric_distribution(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]).select("group", "bin", "count")


@query("""WITH k AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5), n AS (SELECT lang AS "group", CASE WHEN source IN (SELECT source FROM k) THEN source ELSE '(other)' END AS value FROM documents)
SELECT g."group", v.value, (SELECT count(*) FROM n WHERE n."group" = g."group" AND n.value = v.value) AS count FROM (SELECT DISTINCT "group" FROM n) g CROSS JOIN (SELECT DISTINCT value FROM n) v""")
def distribution_categorical(spark, d):
    return relations.categorical_distribution(table(spark, d, "documents"), "source", "lang", 5)


@query(f"SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count, {r4('100.0 * count(*) / (SELECT count(*) FROM labels)')} AS pct FROM labels GROUP BY 1")
def class_balance(spark, d):
    return rounded(relations.class_balance(table(spark, d, "labels"), "quality"))


@query(f"WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT {r4('sqrt((SELECT sum(n * (m - (SELECT avg(l_quantity) FROM lineitem)) ** 2) FROM g) / (SELECT var_pop(l_quantity) * count(*) FROM lineitem))')} AS eta")
def correlation_ratio(spark, d):
    return rounded(relations.correlation_ratio(table(spark, d, "lineitem"), "l_quantity", "l_returnflag"))


@query(f"""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), x AS (SELECT a, sum(o) AS na FROM o GROUP BY 1), y AS (SELECT b, sum(o) AS nb FROM o GROUP BY 1), n AS (SELECT count(*) AS n FROM lineitem),
c AS (SELECT sum((coalesce(o, 0) - na * nb / n) ** 2 / (na * nb / n)) AS chi FROM x CROSS JOIN y CROSS JOIN n LEFT JOIN o ON o.a = x.a AND o.b = y.b)
SELECT {r4("sqrt(chi / (n * (least((SELECT count(*) FROM x), (SELECT count(*) FROM y)) - 1)))")} AS v FROM c, n""")
def cramers_v(spark, d):
    return rounded(relations.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query(f"SELECT l_returnflag AS class, count(l_quantity) AS count, {r4('avg(l_quantity)')} AS mean, {r4('stddev_samp(l_quantity)')} AS std, min(l_quantity) AS min, median(l_quantity) AS median, max(l_quantity) AS max FROM lineitem GROUP BY 1")
def numeric_by_class(spark, d):
    return rounded(relations.numeric_by_class(table(spark, d, "lineitem"), "l_quantity", "l_returnflag"))


@query(f"SELECT lang AS value, CAST(quality AS VARCHAR) AS class, count(*) AS count, {r4('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang)')} AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def class_rates(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(relations.class_rates(df, "lang", "quality"))


@query(f"""WITH q AS (SELECT [quantile_cont(l_extendedprice, k / 4.0) FOR k IN [1, 2, 3]] AS c FROM (SELECT 1)), e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)
SELECT CAST(l_extendedprice > a AS BIGINT) + CAST(l_extendedprice > b AS BIGINT) + CAST(l_extendedprice > c AS BIGINT) AS bin, count(*) AS count, min(l_extendedprice) AS low, max(l_extendedprice) AS high, {r4('avg(l_quantity)')} AS mean FROM lineitem, e GROUP BY 1""".split("\n", 1)[1].join(["WITH e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)\n", ""]))
def binned_target_mean(spark, d):
    return rounded(relations.binned_target_mean(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 4), "low", "high")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r4(information_sql(bins_sql(c, 'lineitem') if number else c, 'l_returnflag', 'lineitem'))} AS mutual_info, '{'eta' if number else 'cramers_v'}' AS measure, {r4((eta_sql if number else cramers_sql)(c, 'l_returnflag', 'lineitem'))} AS strength, {r4(f_sql(c, 'l_returnflag', 'lineitem')) if number else 'CAST(NULL AS DOUBLE)'} AS f" for c, number in (("l_quantity", True), ("l_linestatus", False), ("l_discount", True))))
def association(spark, d):
    return rounded(relations.association(table(spark, d, "lineitem"), ["l_quantity", "l_linestatus", "l_discount"], "l_returnflag").drop("rank"))


@query(f"""WITH u AS (SELECT o_totalprice AS x, 1 AS a, 0 AS b FROM {TRAIN} UNION ALL SELECT o_totalprice, 0, 1 FROM {TEST}), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1)
SELECT {r4("max(gap)")} AS ks FROM (SELECT abs(sum(a) OVER w / (SELECT count(*) FROM {TRAIN}) - sum(b) OVER w / (SELECT count(*) FROM {TEST})) AS gap FROM c WINDOW w AS (ORDER BY x))""")
def drift_ks(spark, d):
    return rounded(relations.ks(*sides(spark, d), "o_totalprice"))


@query(f"SELECT {r4(psi_sql('o_totalprice'))} AS psi")
def drift_psi(spark, d):
    return rounded(relations.psi(*sides(spark, d), "o_totalprice"))


@query(drift_sql("o_totalprice"))
def numeric_drift(spark, d):
    return rounded(relations.numeric_drift(*sides(spark, d), ["o_totalprice"]))


@query(f"""WITH a AS (SELECT o_orderpriority AS v, count(*) * 1.0 / (SELECT count(*) FROM {TRAIN}) AS p FROM {TRAIN} GROUP BY 1), b AS (SELECT o_orderpriority AS v, count(*) * 1.0 / (SELECT count(*) FROM {TEST}) AS p FROM {TEST} GROUP BY 1)
SELECT {r4("sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2")} AS tvd FROM a FULL JOIN b ON a.v = b.v""")
def categorical_drift(spark, d):
    return rounded(relations.total_variation(*sides(spark, d), "o_orderpriority"))


@query(f"""SELECT CAST(o_custkey AS VARCHAR) AS value, 'test' AS side FROM (SELECT o_custkey FROM {TEST} EXCEPT SELECT o_custkey FROM {TRAIN}) UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'train' FROM (SELECT o_custkey FROM {TRAIN} EXCEPT SELECT o_custkey FROM {TEST})""")
def unseen_values(spark, d):
    return relations.unseen_values(*sides(spark, d), "o_custkey")


@query(f"SELECT count(*) AS overlap FROM {TEST} WHERE (o_custkey, o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM {TRAIN})")
def row_overlap(spark, d):
    return relations.row_overlap(*sides(spark, d), ["o_custkey", "o_orderpriority"])


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def label_join_key(spark, d):
    labels = table(spark, d, "labels")
    x = table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left_semi")
    return joins.join_labels(x, labels, "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def merge_table(spark, d):
    return joins.merge_table(lineitem(spark, d, *LINE_COLUMNS), table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", ["p_brand"])


@query("""SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, 0 AS left_duplicated, 0 AS right_duplicated, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_unmatched, 0 AS right_unmatched, (SELECT count(*) FROM documents) AS joined_rows, 0 AS left_missing, 0 AS right_missing, 0::INTEGER AS would_join""")
def key_diagnostics(spark, d):
    return joins.key_diagnostics(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
