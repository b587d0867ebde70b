"""Keys that very many rows have: groups dealt into parts, and joins that no key can load one task with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import written

#: A key is hot if over one in so many rows has it; so there are fewer hot keys than this.
HOT_SHARE = 1000


def dealt(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """rows of keys that two rows have, with (one, two): a key with over `most` rows is dealt into parts, and each pair of parts is a group of its own, so that every two rows meet in a group of at most some 2 * most."""
    rows = written(rows, "dealt")  # read for the counts, the hot keys and the others
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    each = join_counted(rows, counts.withColumn("parts", F.ceil(F.col("n") / most).cast("int")), key).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other")).drop("part", "other", "parts")


def join_counted(rows: DataFrame, side: DataFrame, key: list[str], whole: int | None = None) -> DataFrame:
    """rows joined with side, which has one row for each key, and in n how many of rows have it.

    Keys of over 1 / HOT_SHARE of the counted rows are fewer than HOT_SHARE, so their side is broadcast
    and their rows stay where they are; the others meet in a shuffle. rows are read twice, so a written
    table is best. whole, where it is known, is the sum of n or a bound of it. n is dropped."""
    whole = whole if whole is not None else side.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = whole / HOT_SHARE
    hot = F.broadcast(side.where(F.col("n") > least).drop("n"))
    cold = side.where(F.col("n") <= least).drop("n")
    here = rows.join(hot, key)
    there = rows.join(hot.select(*key), key, "left_anti").join(cold, key)
    return here.unionByName(there)
