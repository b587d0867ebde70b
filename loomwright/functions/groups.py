"""Values of a row from the rows of its entity: mean, last seen, and interpolation between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_key(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def group_mean(value: Column, by: Column) -> Column:
    return F.when(by.isNotNull(), F.avg(value).over(W.partitionBy(by)))


def _ordered(by: Column, order: Column, ties: list[Column]):
    known = by.isNotNull() & order.isNotNull()
    return known, W.partitionBy(by, known).orderBy(order, *ties)


def group_prev(value: Column, by: Column, order: Column, ties: list[Column]) -> Column:
    known, window = _ordered(by, order, ties)
    return F.when(known, F.last(value, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0)))


def group_interp(value: Column, by: Column, order: Column, ties: list[Column]) -> Column:
    """Linear between the nearest observed rows on either side; halfway where their orders tie; none outside."""
    known, window = _ordered(by, order, ties)
    seen = F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))
    a = F.last(seen, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))
    b = F.first(seen, ignorenulls=True).over(window.rowsBetween(0, W.unboundedFollowing))
    gap = b["o"] - a["o"]
    share = F.when(gap > 0, (order - a["o"]) / gap).otherwise(0.5)
    return F.when(known, F.coalesce(value, a["v"] + (b["v"] - a["v"]) * share))
