"""Joins that check their keys: labels one to one, tables many to one, and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.errors import EngineError
from loomwright.operators.base import RID, col, need
from loomwright.session import bounded_broadcast, with_rid

MOST_BROADCAST = 200_000


def key_diagnostics(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """One row: counts, missing, duplicated and unmatched keys of both sides, rows of a left join, would_join (strictly one to one)."""
    def counted(df, name, k):
        return df.where(col(name).isNotNull()).groupBy(col(name).alias("k")).agg(F.count("*").alias(k))

    a, b = counted(left, key, "na"), counted(right, right_key or key, "nb")
    both = a.join(b, "k", "full_outer")
    whole = both.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("nb"), F.lit(0)).alias("right_rows"), F.count_if(F.col("na") > 1).alias("left_duplicated"), F.count_if(F.col("nb") > 1).alias("right_duplicated"),
        F.coalesce(F.sum(F.when(F.col("nb").isNull(), F.col("na"))), F.lit(0)).alias("left_unmatched"), F.coalesce(F.sum(F.when(F.col("na").isNull(), F.col("nb"))), F.lit(0)).alias("right_unmatched"),
        F.coalesce(F.sum(F.col("na") * F.coalesce("nb", F.lit(1))), F.lit(0)).alias("joined_rows"),
    )
    gone = left.agg(F.count_if(col(key).isNull()).alias("left_missing")).crossJoin(right.agg(F.count_if(col(right_key or key).isNull()).alias("right_missing")))
    out = whole.crossJoin(gone).withColumn("joined_rows", F.col("joined_rows") + F.col("left_missing"))
    bad = [F.col(f"{s}_{w}") for s in ("left", "right") for w in ("missing", "duplicated", "unmatched")]
    clean = bad[0] == 0
    for b_ in bad[1:]:
        clean = clean & (b_ == 0)
    return out.withColumn("would_join", clean.cast("int"))


def join_labels(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """Strictly one to one; anything else is an error that names the counts."""
    need(x, key)
    need(y, key)
    if clash := set(x.columns) & set(y.columns) - {key}:
        raise EngineError(f"both sides have a column {sorted(clash)[0]!r}")
    row = key_diagnostics(x, y, key).first().asDict()
    if not row.pop("would_join"):
        raise EngineError(f"labels don't join one to one: {row}")
    return x.join(y, key)


def join_by_order(x: DataFrame, y: DataFrame, index: str | None = None) -> DataFrame:
    """Row by row; the row counts must agree, and so must an index column."""
    a, b = (d if RID in d.columns else with_rid(d) for d in (x, y))
    if a.count() != b.count():
        raise EngineError("the two sides have different numbers of rows")
    if index:
        wrong = a.select(RID, col(index).alias("l")).join(b.select(RID, col(index).alias("r")), RID).where(~F.col("l").eqNullSafe(F.col("r"))).limit(1).count()
        if wrong:
            raise EngineError(f"the index {index!r} differs")
        b = b.drop(index)
    return a.join(b, RID)


def merge_table(x: DataFrame, table: DataFrame, key: str, columns=None) -> DataFrame:
    """A left join many to one; the table's keys must be unique and known."""
    need(x, key)
    need(table, key)
    columns = columns or [c for c in table.columns if c != key]
    if clash := set(columns) & set(x.columns):
        raise EngineError(f"the frame has a column {sorted(clash)[0]!r} already")
    bad = table.groupBy(col(key).alias("k")).count().where("k IS NULL OR count > 1").limit(1).count()
    if bad:
        raise EngineError(f"the table's key {key!r} is missing or repeated in a row")
    side = bounded_broadcast(table.select(col(key), *[col(c) for c in columns]), MOST_BROADCAST)
    return x.join(side, key, "left").select(*[col(c) for c in x.columns], *[col(c) for c in columns])


def is_index_like(df: DataFrame, name: str, order: str = RID) -> bool:
    """0 .. n-1 or 1 .. n in the frame's order."""
    row = df.agg(F.min(col(name) - col(order)).alias("a"), F.max(col(name) - col(order)).alias("b"), F.count_if(col(name).isNull()).alias("n")).first()
    return row["n"] == 0 and row["a"] is not None and row["a"] == row["b"] and row["a"] in (0, 1)
