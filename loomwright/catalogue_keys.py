"""Registered queries of the analyses by id, of advice, and of what they are made of, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright import keys
from loomwright.analysis import advisor, cleanliness, profile, relations
from loomwright.catalogue import LABELLED, TEST, TRAIN, bins_sql, cramers_sql, eta_sql, f_sql, information_sql, labelled, lineitem, query, r4, rounded, sides, table
from loomwright.operators.select import f_scores, information_scores


def run(spark, name, **params):
    return keys.run(spark, name, params)


def orders(spark, d):
    return table(spark, d, "orders").withColumn("_rid", F.col("o_orderkey"))


# -- keys -------------------------------------------------------------------------------------


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, 'id_like' AS semantic, count(*) AS rows, 0::BIGINT AS missing, count(DISTINCT o_orderkey) AS n_unique FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', 'categorical', count(*), 0, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', 'double', 'numeric', count(*), 0, count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 'datetime', count(*), 0, count(DISTINCT o_orderdate) FROM orders""")
def key_dataset_overview(spark, d):
    return run(spark, "dataset_overview", source=orders(spark, d).select("_rid", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))["columns"]


@query("""SELECT 'event_id' AS "column", 'bigint' AS train_dtype, 'string' AS test_dtype, 0.0::DOUBLE AS train_missing_pct, 0.0::DOUBLE AS test_missing_pct, 'type_mismatch' AS status
UNION ALL SELECT 'value', 'double', NULL, 0.0, NULL, 'only_train' UNION ALL SELECT 'user_id', 'bigint', 'bigint', 0.0, """ + r4("(SELECT 100.0 * avg(CAST(event_id % 4 = 0 AS INTEGER)) FROM events WHERE event_id % 2 = 1 OR event_id % 4 = 0)") + """, 'match' UNION ALL SELECT 'extra', NULL, 'int', NULL, 0.0, 'only_test'""")
def schema_compare(spark, d):
    events = table(spark, d, "events")
    train = events.select("event_id", "value", "user_id")
    test = events.where("event_id % 2 = 1 OR event_id % 4 = 0").select(F.col("event_id").cast("string").alias("event_id"), F.expr("CASE WHEN event_id % 4 > 0 THEN user_id END").alias("user_id"), F.lit(1).alias("extra"))
    return rounded(relations.compare_columns(train, test))


SPELLED = "CASE WHEN o_orderkey % 50 = 0 THEN lower(o_orderpriority) || '. ' WHEN o_orderkey % 51 = 0 THEN 'none' ELSE o_orderpriority END"
SPELLED_SQL = f"(SELECT {SPELLED} AS v FROM {TEST})"


@query(f"""SELECT DISTINCT v AS test, (SELECT min(o_orderpriority) FROM {TRAIN} WHERE lower(o_orderpriority) = rtrim(trim(v), '.')) AS train FROM {SPELLED_SQL} WHERE v LIKE '%. '""")
def near_matches(spark, d):
    train, test = sides(spark, d)
    return relations.near_matches(train, test.select(F.expr(SPELLED).alias("o_orderpriority")), "o_orderpriority")


@query("""SELECT 'flag' AS "column", 'only_train' AS issue, 'high' AS severity UNION ALL SELECT 'o_orderpriority', 'value_mismatch', 'high' UNION ALL SELECT 'o_totalprice', 'drift', 'high' UNION ALL SELECT 'more', 'only_test', 'low'""")
def key_train_test_check(spark, d):
    train, test = sides(spark, d)
    train = train.withColumn("flag", F.lit(1)).select("o_orderkey", "o_orderpriority", "o_totalprice", "flag").withColumn("_rid", F.col("o_orderkey"))
    test = test.select("o_orderkey", F.expr(SPELLED).alias("o_orderpriority"), (F.col("o_totalprice") * 3).alias("o_totalprice"), F.lit("x").alias("more")).withColumn("_rid", F.col("o_orderkey"))
    return run(spark, "train_test_check", train=train, test=test)["issues"].drop("detail")


@query(f"""WITH t AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM {TEST}) SELECT 'o_custkey' AS "column", count(*) AS n_test, count(*) FILTER (v IN (SELECT CAST(o_custkey AS VARCHAR) FROM {TRAIN})) AS n_test_in_train, {r4(f"100.0 * count(*) FILTER (v IN (SELECT CAST(o_custkey AS VARCHAR) FROM {TRAIN})) / count(*)")} AS pct_test_in_train FROM t""")
def id_overlap(spark, d):
    return rounded(relations.id_overlap(*sides(spark, d), ["o_custkey"]))


@query(f"""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), g AS (SELECT k, a + k * ((b - a) / 30) AS low, a + (k + 1) * ((b - a) / 30) AS high FROM e, range(30) r(k)),
t AS (SELECT least(CAST(floor((o_totalprice - a) / ((b - a) / 30)) AS BIGINT), 29) AS k, count(*) * 1.0 / (SELECT count(*) FROM {TRAIN}) AS p FROM {TRAIN}, e GROUP BY 1), u AS (SELECT least(CAST(floor((o_totalprice - a) / ((b - a) / 30)) AS BIGINT), 29) AS k, count(*) * 1.0 / (SELECT count(*) FROM {TEST}) AS q FROM {TEST}, e GROUP BY 1)
SELECT g.k AS bin, {r4("low")} AS low, {r4("high")} AS high, {r4("coalesce(p, 0)")} AS train, {r4("coalesce(q, 0)")} AS test FROM g LEFT JOIN t ON t.k = g.k LEFT JOIN u ON u.k = g.k""")
def histogram_pair(spark, d):
    return rounded(relations.histogram_pair(*sides(spark, d), "o_totalprice"))


@query(f"""SELECT 'quality' AS "column", count(*) - count(quality) AS missing, {r4("100.0 * (count(*) - count(quality)) / count(*)")} AS rate, CASE WHEN 100.0 * (count(*) - count(quality)) / count(*) > 60 THEN 'drop' WHEN 100.0 * (count(*) - count(quality)) / count(*) > 20 THEN 'review' WHEN count(*) > count(quality) THEN 'impute' ELSE 'complete' END AS advice FROM {LABELLED}
UNION ALL SELECT 'lang', 0, 0.0::DOUBLE, 'complete'""")
def key_missing_values(spark, d):
    df = labelled(spark, d).select(F.col("doc_id").alias("_rid"), "lang", "quality")
    return rounded(run(spark, "missing_values", source=df)["missing_rates"])


@query("""WITH s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM s)
SELECT value, count(*) AS count, CASE WHEN value < any_value(lo) THEN 'low' ELSE 'high' END AS side FROM events, f WHERE value < lo OR value > hi GROUP BY value ORDER BY greatest(any_value(lo) - value, value - any_value(hi)) DESC, value LIMIT 20""")
def key_outliers(spark, d):
    return run(spark, "outliers", source=table(spark, d, "events").select(F.col("event_id").alias("_rid"), "value"), columns=["value"], method="iqr")["outlier_values:value"]


@query("""SELECT 'o_orderstatus' AS "column", count(*) FILTER (a > 1) AS keys FROM (SELECT count(DISTINCT o_orderstatus) AS a FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'o_orderpriority', count(*) FILTER (a > 1) FROM (SELECT count(DISTINCT o_orderpriority) AS a FROM orders GROUP BY o_custkey HAVING count(*) > 1)""")
def key_duplicates(spark, d):
    return run(spark, "duplicates", source=orders(spark, d).select("_rid", "o_custkey", "o_orderstatus", "o_orderpriority"), id_column="o_custkey")["conflicting_columns"]


MIXED = "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS STRING) ELSE p_type END"


@query("SELECT count(*) FILTER (p_partkey % 3 = 0) AS numbers, count(*) FILTER (p_partkey % 3 > 0) AS texts FROM part")
def key_inconsistencies(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("_rid"), F.expr(MIXED).alias("kind"))
    return run(spark, "inconsistencies", source=df)["mixed_types:kind"]


@query(f"""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r4("corr(l_quantity, l_extendedprice)")} AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', {r4("corr(l_quantity, l_discount)")} FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', {r4("corr(l_extendedprice, l_discount)")} FROM lineitem""")
def key_correlations(spark, d):
    df = lineitem(spark, d, "l_quantity", "l_extendedprice", "l_discount").withColumn("_rid", F.lit(0))
    return rounded(run(spark, "correlations", source=df)["matrix"])


@query(f"""SELECT l_returnflag AS class, count(l_quantity) AS count, {r4("avg(l_quantity)")} AS mean, {r4("stddev_samp(l_quantity)")} AS std, min(l_quantity) AS min, {r4("median(l_quantity)")} AS median, max(l_quantity) AS max FROM lineitem GROUP BY 1""")
def key_column_distribution(spark, d):
    df = lineitem(spark, d, "l_quantity", "l_returnflag").withColumn("_rid", F.lit(0))
    return rounded(run(spark, "column_distribution", source=df, column="l_quantity", by="l_returnflag")["numeric_summary"])


@query(f"""SELECT 'l_quantity' AS "column", {r4(information_sql(bins_sql("l_quantity", "lineitem"), "l_returnflag", "lineitem"))} AS mutual_info, {r4(eta_sql("l_quantity", "l_returnflag", "lineitem"))} AS strength
UNION ALL SELECT 'l_linestatus', {r4(information_sql("l_linestatus", "l_returnflag", "lineitem"))}, {r4(cramers_sql("l_linestatus", "l_returnflag", "lineitem"))}""")
def key_target_analysis(spark, d):
    df = lineitem(spark, d, "l_quantity", "l_linestatus", "l_returnflag").withColumn("_rid", F.lit(0))
    return rounded(run(spark, "target_analysis", source=df, target="l_returnflag")["ranking"].select("column", "mutual_info", "strength"))


def score_sql(c):
    return f"SELECT '{c}' AS \"column\", {r4(f_sql(c, 'l_returnflag', 'lineitem'))} AS f, {r4(information_sql(bins_sql(c, 'lineitem'), 'l_returnflag', 'lineitem'))} AS mutual_info"


SCORED = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(map(score_sql, SCORED)))
def key_feature_selection(spark, d):
    df = lineitem(spark, d, *SCORED, "l_returnflag").withColumn("_rid", F.lit(0))
    rows = run(spark, "feature_selection", source=df, target="l_returnflag")["scores"]
    return rounded(spark.createDataFrame([(r["column"], r["f"], r["mutual_info"]) for r in rows], "column string, f double, mutual_info double"))


@query("SELECT * FROM (" + " UNION ALL ".join(map(score_sql, SCORED)) + ")")
def feature_scores(spark, d):
    df = lineitem(spark, d, *SCORED, "l_returnflag")
    f, mi = f_scores(df, list(SCORED), "l_returnflag", "classification"), information_scores(df, list(SCORED), "l_returnflag", "classification")
    return rounded(spark.createDataFrame([(c, f[c], mi[c]) for c in SCORED], "column string, f double, mutual_info double"))


@query("""SELECT 'drop_columns' AS op, 'o_orderkey' AS "column", 'leak' AS category UNION ALL SELECT 'drop_columns', 'late', 'leak' UNION ALL SELECT 'drop_columns', 'same', 'drop' UNION ALL SELECT 'drop_columns', 'o_totalprice_net', 'leak' UNION ALL SELECT 'drop_columns', 'thin', 'drop'
UNION ALL SELECT 'datetime_parts', 'o_orderdate', 'encoding' UNION ALL SELECT 'drop_columns', 'o_orderdate', 'encoding' UNION ALL SELECT 'ordinal', 'level', 'encoding' UNION ALL SELECT 'onehot', 'o_orderstatus', 'encoding'""")
def key_preprocessing_advisor(spark, d):
    df = orders(spark, d).select(
        "_rid", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", (F.col("o_totalprice") * 0.8).alias("o_totalprice_net"), F.lit("one").alias("same"), F.expr("element_at(array('low', 'medium', 'high'), CAST(o_orderkey % 3 + 1 AS INT))").alias("level"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 0.1 END").alias("thin"), F.lit("x").alias("late"),
    )
    steps = run(spark, "preprocessing_advisor", source=df, target="o_totalprice", model="tree", test=df.drop("late", "o_totalprice"))["recommendations"]
    name = lambda p: (p.get("columns") or [p.get("column") or next(iter(p.get("categories") or {"": 0}))])[0]
    return spark.createDataFrame([(s["op"], name(s["params"]), s["category"]) for s in steps], "op string, column string, category string")


@query("SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_unmatched, CAST((SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS INTEGER) AS would_join")
def key_label_join_preview(spark, d):
    x, y = (table(spark, d, t).withColumn("_rid", F.col("doc_id")) for t in ("documents", "labels"))
    return run(spark, "label_join_preview", x=x.select("_rid", "doc_id"), y=y, key="doc_id")["candidates"]["doc_id"].select("left_rows", "right_rows", "left_unmatched", "would_join")


@query("SELECT 'p_partkey' AS name, 'bigint' AS dtype, true AS numeric, count(*) AS rows FROM part UNION ALL SELECT 'p_brand', 'string', false, count(*) FROM part UNION ALL SELECT 'p_size', 'int', true, count(*) FROM part")
def key_file_inspect(spark, d):
    found = run(spark, "file_inspect", source={"kind": "parquet", "path": f"{d}/part.parquet", "columns": ["p_partkey", "p_brand", "p_size"]})
    return spark.createDataFrame([(c["name"], c["dtype"], c["numeric"], found["rows"][0]["rows"]) for c in found["columns"]], "name string, dtype string, numeric boolean, rows long")


@query(f"SELECT o_orderpriority, {r4('avg(o_totalprice)')} AS value FROM orders GROUP BY 1")
def key_chart(spark, d):
    return rounded(run(spark, "chart", source=orders(spark, d), kind="bar", x="o_orderpriority", y="o_totalprice", how="mean")["data"])


@query(f"""SELECT {r4("regr_slope(l_extendedprice, l_quantity)")} AS slope, {r4("regr_intercept(l_extendedprice, l_quantity)")} AS intercept, {r4("regr_r2(l_extendedprice, l_quantity)")} AS r2 FROM lineitem""")
def chart_trend(spark, d):
    from loomwright.analysis import charts

    return rounded(charts.trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


# -- parts ------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS cardinality, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top_value, {r4("(SELECT max(p) FROM c)")} AS top_pct, {r4("(SELECT coalesce(sum(p), 0) FROM c WHERE p < 1)")} AS rare_pct""")
def category_summary(spark, d):
    return rounded(profile.category_summary(table(spark, d, "orders"), "o_orderpriority"))


@query("""SELECT 'o_orderkey' AS "column", 'id_like' AS semantic UNION ALL SELECT 'o_custkey', 'group_id' UNION ALL SELECT 'o_orderstatus', 'categorical' UNION ALL SELECT 'o_totalprice', 'numeric' UNION ALL SELECT 'o_orderdate', 'datetime' UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT 'one', 'constant' UNION ALL SELECT 'pair', 'nested' UNION ALL SELECT 'raw', 'binary' UNION ALL SELECT 'price', 'text'""")
def semantic_types(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", (F.col("o_orderkey") % 2).alias("flag"), F.lit("a").alias("one"), F.array("o_orderkey", "o_custkey").alias("pair"), F.col("o_orderpriority").cast("binary").alias("raw"), F.concat(F.lit("EUR "), F.col("o_totalprice").cast("string")).alias("price"))
    return profile.column_profile(df, exact=True).select("column", "semantic")


@query("""SELECT 'mostly' AS "column", 'a' AS value, 100.0 * count(*) FILTER (p_partkey % 25 > 0) / count(*) AS pct FROM part""")
def near_constant(spark, d):
    df = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 25 > 0 THEN 'a' ELSE p_brand END").alias("mostly"), "p_size")
    return relations.near_constant(df, ["mostly", "p_size"])


@query(f"""WITH r AS (SELECT abs(corr(p_size, p_retailprice)) AS r FROM part) SELECT 1 AS component, {r4("(1 + r) / 2")} AS share, {r4("(1 + r) / 2")} AS cumulative FROM r UNION ALL SELECT 2, {r4("(1 - r) / 2")}, 1.0 FROM r""")
def pca_variance(spark, d):
    return rounded(relations.pca_variance(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query(f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r4("r")} AS corr, 'l_quantity' AS keep FROM c WHERE abs(r) >= 0.1""")
def correlated_pairs(spark, d):
    return rounded(relations.correlated_pairs(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 0.1))


@query(f"""WITH t AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS v FROM {TEST}), n AS (SELECT v, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, v LIMIT 3)
SELECT v AS value, n AS n_test, 0::BIGINT AS n_train, {r4("n * 1.0 / (SELECT count(*) FROM t)")} AS test_share, 0.0::DOUBLE AS train_share FROM n WHERE v = 'new'""")
def value_spikes(spark, d):
    train, test = sides(spark, d)
    test = test.withColumn("o_orderpriority", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END"))
    return rounded(cleanliness.value_spikes(train, test, "o_orderpriority"))


@query(f"""WITH e AS (SELECT min(l_quantity) AS xa, max(l_quantity) AS xb, min(l_tax) AS ya, max(l_tax) AS yb FROM lineitem) SELECT least(CAST(floor((l_quantity - xa) / ((xb - xa) / 30)) AS BIGINT), 29) AS bx, least(CAST(floor((l_tax - ya) / ((yb - ya) / 30)) AS BIGINT), 29) AS "by", count(*) AS count FROM lineitem, e GROUP BY ALL""")
def chart_density(spark, d):
    from loomwright.analysis import charts

    return charts.density(table(spark, d, "lineitem"), "l_quantity", "l_tax")


@query()
def impute_benchmark(spark, d):
    """Known cells hidden by a seeded hash, filled by three strategies: errors of each."""
    return advisor.impute_benchmark(orders(spark, d), ["o_totalprice"])


@query("""SELECT 'o_orderkey' AS "column", 'match' AS status, CAST(NULL AS VARCHAR) AS similar UNION ALL SELECT 'o_orderpriority', 'value_mismatch', NULL UNION ALL SELECT 'o_totalprice', 'label', NULL UNION ALL SELECT 'o_custkey', 'type_mismatch', NULL UNION ALL SELECT 'o_orderstatus', 'missing_in_test', 'o_order_status' UNION ALL SELECT 'o_order_status', 'extra_in_test', 'o_orderstatus'""")
def align_report(spark, d):
    train, test = sides(spark, d)
    test = test.select("o_orderkey", F.expr(SPELLED).alias("o_orderpriority"), F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderstatus").alias("o_order_status"))
    return relations.align_report(train.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey", "o_orderstatus"), test, "o_totalprice")


@query(f"""WITH r AS (SELECT l_quantity AS x, l_discount AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS ry FROM lineitem)
SELECT 'pearson' AS method, {r4("corr(x, y)")} AS corr, count(*) AS n FROM r UNION ALL SELECT 'spearman', {r4("corr(rx, ry)")}, count(*) FROM r""")
def vs_by(spark, d):
    return rounded(relations.vs_by(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@query("""SELECT 'city' AS "column", count(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END) AS spellings, count(DISTINCT p_brand) AS forms, false AS looks_like_dates, false AS numbers_as_text, false AS currency_as_text, false AS skewed FROM part
UNION ALL SELECT 'day', count(DISTINCT p_partkey % 28), count(DISTINCT p_partkey % 28), true, false, false, false FROM part UNION ALL SELECT 'digits', count(DISTINCT p_size), count(DISTINCT p_size), false, true, false, false FROM part
UNION ALL SELECT 'price', count(DISTINCT p_size), count(DISTINCT p_size), false, false, true, false FROM part UNION ALL SELECT 'long_tail', 0, 0, false, false, false, true""")
def text_facts(spark, d):
    df = table(spark, d, "part").select(
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END").alias("city"), F.expr("concat(p_partkey % 28 + 1, ' Mar 2001')").alias("day"), F.col("p_size").cast("string").alias("digits"), F.expr("concat('EUR ', p_size)").alias("price"),
        F.pow(F.lit(1.01), F.col("p_partkey") % 900).alias("long_tail"),
    )
    return cleanliness.text_facts(df)
