"""Registered queries of sources, sinks and workspaces: the driver's tables are written in a form, and read back through it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.analysis import joins
from loomwright.catalogue import SPLIT, lineitem, query, r4, rounded, sides, step, table
from loomwright.pipeline import pipeline
from loomwright.plans.workspace import Workspace, column_notes, page, preview
from loomwright.session import shared_folder
from loomwright.sources import load, sinks, source_columns

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def place(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(*ORDERS.split(", "))


@query(f"SELECT {ORDERS} FROM orders")
def source_csv(spark, d):
    path = place(spark)
    sinks.write_csv(orders(spark, d).repartition(3), path)
    return load(spark, {"kind": "csv", "path": path}).drop("_rid")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS note, '0' || CAST(o_custkey AS VARCHAR) AS code, o_orderkey % 2 = 0 AS even FROM orders")
def source_csv_marks(spark, d):
    """Semicolons, decimal commas, missing marks, leading zeros and booleans, all found by sniffing."""
    price = F.when(F.col("o_orderkey") % 3 > 0, F.translate(F.format_number("o_totalprice", 2), ",.", "_,"))
    cells = [F.col("o_orderkey").cast("string"), F.coalesce(F.translate(price, "_", ""), F.lit("NA")), F.coalesce(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")), F.lit("")), F.concat(F.lit("0"), F.col("o_custkey").cast("string")), (F.col("o_orderkey") % 2 == 0).cast("string")]
    lines = table(spark, d, "orders").coalesce(1).select(F.concat_ws(";", *cells).alias("value"))
    path = place(spark)
    spark.createDataFrame([("o_orderkey;price;note;code;even",)], "value string").union(lines).coalesce(1).write.text(path)
    return load(spark, {"kind": "csv", "path": path}).drop("_rid")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F')")
def source_parquet(spark, d):
    return load(spark, {"kind": "parquet", "path": f"{d}/orders.parquet", "columns": ["o_orderkey", "o_totalprice"], "filters": [["o_totalprice", ">", 100000.0], ["o_orderstatus", "in", ["O", "F"]]]})


@query("SELECT o_orderkey, o_custkey AS who_id, o_orderstatus AS who_status FROM orders")
def source_json(spark, d):
    path = place(spark)
    orders(spark, d).select("o_orderkey", F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("who")).write.json(path)
    return load(spark, {"kind": "json", "path": path, "lines": True})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_json_records(spark, d):
    path = place(spark)
    nation = table(spark, d, "nation")
    whole = nation.agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(*nation.columns)).alias("rows")).alias("data"))).alias("value"))  # one document is the form's point
    whole.write.text(path)
    return load(spark, {"kind": "json", "path": path, "record_path": "data.rows"}).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def source_sql(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("loom_orders")
    return load(spark, {"kind": "sql", "query": "SELECT o_orderstatus, count(*) AS n FROM loom_orders GROUP BY 1"})


def space(spark, d) -> Workspace:
    train, test = (x.select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("_rid", F.col("o_orderkey")) for x in sides(spark, d))
    made = Workspace("orders", {"train": train, "test": test})
    return made.add("filter_rows", {"conditions": [{"column": "o_totalprice", "op": "ge", "value": 5000}]}).add("scale", {"columns": ["o_totalprice"]})


SPACE = f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate < TIMESTAMP '{SPLIT}' AS train FROM orders WHERE o_totalprice >= 5000), s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM o WHERE train)
SELECT o_orderkey, o_orderstatus, {r4("(o_totalprice - m) / s")} AS o_totalprice FROM o, s WHERE """


@query(SPACE + "NOT train")
def source_dataset(spark, d):
    """Test after its steps, with what they learned on train."""
    return rounded(load(spark, {"kind": "dataset", "workspace": space(spark, d), "role": "test"}).drop("_rid"))


@query(SPACE + "train UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM (" + SPACE + "NOT train) t")
def sink_export(spark, d):
    """Every role of a workspace, written and read back by its manifest."""
    found = sinks.export(space(spark, d), spark, place(spark))
    return rounded(spark.read.parquet(found["files"][0]).unionByName(spark.read.parquet(found["files"][1])))


@query(f"SELECT {ORDERS} FROM orders")
def sink_parquet(spark, d):
    path = place(spark)
    sinks.write_parquet(orders(spark, d), path)
    return load(spark, path + "/*.parquet")


@query("SELECT 'o_orderkey' AS name, 'bigint' AS dtype, true AS numeric UNION ALL SELECT 'o_orderstatus', 'string', false UNION ALL SELECT 'o_totalprice', 'double', true")
def source_columns_(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return spark.createDataFrame([(c["name"], c["dtype"], c["numeric"]) for c in source_columns(df)], "name string, dtype string, numeric boolean")


@query(f"""SELECT o_orderkey AS _rid, 'o_totalprice' AS "column", {r4("o_totalprice")} AS before, {r4("q")} AS after FROM orders, (SELECT quantile_cont(o_totalprice, 0.9) AS q FROM orders) WHERE o_totalprice > q ORDER BY o_orderkey LIMIT 2000""")
def preview_cells(spark, d):
    """Cells that a further step would change; the first 2000 are the feature."""
    made = Workspace("orders", {"train": table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("_rid", F.col("o_orderkey"))})
    cells = preview(made, spark, "clip", {"columns": ["o_totalprice"], "lower": 0.0, "upper": 90.0})["cells"]
    value = lambda c: F.get_json_object(c, "$.v").cast("double").alias(c)
    return rounded(cells.select("_rid", "column", value("before"), value("after")))


@query("SELECT o_orderkey AS _rid FROM orders WHERE o_orderstatus <> 'O'")
def preview_removed(spark, d):
    made = Workspace("orders", {"train": table(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("_rid", F.col("o_orderkey"))})
    return preview(made, spark, "filter_rows", {"conditions": [{"column": "o_orderstatus", "op": "eq", "value": "O"}]})["removed"]


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice NULLS LAST, o_orderkey) - 1 AS place FROM orders")
def sort_rows(spark, d):
    from loomwright.session import with_rid

    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").withColumn("_rid", F.col("o_orderkey"))
    return with_rid(step(df, "sort_rows", by=["o_orderpriority", "o_totalprice"], ascending=[False, True]), "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10000")
def page_deep(spark, d):
    """A sorted, filtered page far down, found by the rows' places."""
    return page(orders(spark, d).withColumn("_rid", F.col("o_orderkey")), 10_000, 50, ["o_orderkey", "o_totalprice"], [{"column": "o_orderstatus", "op": "ne", "value": "P"}], sort=["o_totalprice"], ascending=False)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def label_join_order(spark, d):
    customer = table(spark, d, "customer").withColumn("_rid", F.col("c_custkey"))
    return joins.join_by_order(customer.select("_rid", "c_custkey", "c_name"), customer.select("_rid", "c_custkey", "c_acctbal"), "c_custkey").drop("_rid")


@query("SELECT true AS counter, false AS other")
def index_like(spark, d):
    df = table(spark, d, "orders").withColumn("_rid", F.col("o_orderkey"))
    return spark.createDataFrame([(bool(joins.is_index_like(df, "o_orderkey")), bool(joins.is_index_like(df, "o_custkey")))], "counter boolean, other boolean")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r4('(least(l_quantity, 40) - m) / s')} AS l_quantity FROM lineitem, (SELECT avg(least(l_quantity, 40)) AS m, stddev_pop(least(l_quantity, 40)) AS s FROM lineitem)")
def ml_stages(spark, d):
    """Two transforms as stages of a pyspark.ml pipeline. The bound of 40 is a value; those of clip are percentiles."""
    df = lineitem(spark, d, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(pipeline([{"op": "formula", "params": {"name": "l_quantity", "expr": "min(l_quantity, 40)"}}, {"op": "scale", "params": {"columns": ["l_quantity"]}}]).fit(df).transform(df))


@query("SELECT 'order_id' AS \"column\", 'o_orderkey' AS raw, 'the key' AS note UNION ALL SELECT 'x_o_totalprice', 'o_totalprice', 'in euros'")
def column_notes_(spark, d):
    """Notes follow their columns through renames."""
    made = Workspace("orders", {"train": {"kind": "parquet", "path": f"{d}/orders.parquet"}}, notes={"o_orderkey": "the key", "o_totalprice": "in euros"})
    made.add("rename", {"mapping": {"o_orderkey": "order_id"}}).add("rename_columns_bulk", {"columns": ["o_totalprice"], "prefix": "x_"})
    found = column_notes(made, spark)
    return spark.createDataFrame([(c, found["keys"][c], text) for c, text in found["notes"].items()], "column string, raw string, note string")
