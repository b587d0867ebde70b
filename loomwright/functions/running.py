"""Running totals over a whole frame without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.session import written


def running(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """df with `<value>_upto`: the total of value up to and with the row, in the order of the columns.

    Rows are dealt into ranges; each range is added up on its own, and a range's start comes from the
    totals of those before it (one row for each range meets on the driver)."""
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(*[F.sum(v).alias(v) for v in values]).orderBy("__range").collect()
    starts, upto = [], [0] * len(values)
    for row in totals:
        starts.append((row["__range"], *upto))
        upto = [a + (row[v] or 0) for a, v in zip(upto, values, strict=True)]
    kinds = [df.select(F.sum(v).alias(v)).schema[v].dataType.simpleString() for v in values]
    schema = ", ".join(["__range int", *(f"`__start_{v}` {k}" for v, k in zip(values, kinds, strict=True))])
    table = df.sparkSession.createDataFrame(starts or [(0, *upto)], schema)
    own = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(table), "__range")
    return placed.withColumns({f"{v}_upto": F.col(f"__start_{v}") + F.sum(v).over(own) for v in values}).drop("__range", *(f"__start_{v}" for v in values))


def value_counts(df: DataFrame, value, name: str = "x") -> DataFrame:
    """(x, n, n_upto) of the known values of an expression, ascending."""
    return running(df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")), [name], ["n"])


def ranged_quantiles(df: DataFrame, value, shares: list[float]) -> list[float] | None:
    """Exact quantiles (linear between neighbours) by the values' places; None without a value."""
    counts = written(value_counts(df, value), "places")
    total = counts.agg(F.max("n_upto").alias("n")).first()["n"]
    if not total:
        return None
    places = sorted({p for s in shares for p in (int(s * (total - 1)), min(int(s * (total - 1)) + 1, total - 1))})
    wanted = df.sparkSession.createDataFrame([(p,) for p in places], "place long")
    inside = (F.col("place") < F.col("n_upto")) & (F.col("place") >= F.col("n_upto") - F.col("n"))
    found = {r["place"]: r["x"] for r in counts.join(F.broadcast(wanted), inside).select("place", "x").collect()}  # two for each share
    out = []
    for s in shares:
        at = s * (total - 1)
        low = int(at)
        a, b = found[low], found[min(low + 1, total - 1)]
        out.append(a + (b - a) * (at - low))
    return out
