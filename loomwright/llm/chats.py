"""Chat logs: keep conversations that no longer one continues, and render them.

Logs often hold a conversation again and again as it grows. The rolling hash of a conversation's
first k turns identifies every prefix; a conversation whose whole hash is a proper prefix of another
is a snapshot of it and goes, by an anti-join. Of equal conversations the smallest conv_id stays.
Prefix hashes are made distinct before the join, so a first turn that millions share is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.session import written

HEAD, TAIL = "<|im_start|>", "<|im_end|>"


def turn_hash(lane: int) -> Column:
    return F.xxhash64(F.lit(lane), F.col("k"), F.length("role"), F.col("role"), F.col("text"))


def turns(chats: DataFrame) -> DataFrame:
    """Rows (conv_id, k, role, text), k from 1 in order of turn; exactly repeated rows count once.

    A null role or text is empty, a null turn comes first, rows of one turn go by role and text; rows
    with a null conv_id belong to no conversation and are left out."""
    rows = chats.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv_id IS NOT NULL").distinct()
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("k", F.row_number().over(order))


def prefixes(chats: DataFrame) -> DataFrame:
    """turns with n, their conversation's number, and h1, h2: 128 bits over the first k (each turn's hash holds its place). A written table: turns are ordered once for all that reads them."""
    upto = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = turns(chats).withColumn("h1", F.bit_xor(turn_hash(1)).over(upto)).withColumn("h2", F.bit_xor(turn_hash(2)).over(upto))
    return written(rows.withColumn("n", F.count("*").over(W.partitionBy("conv_id"))), "chat-prefixes")


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n) of conversations that are no prefix of a longer one, one of each equal group; rows are prefixes."""
    key = [F.col("k").cast("long").alias("n"), "h1", "h2"]
    full = rows.where("k = n").select(*key, "conv_id").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = rows.where("k < n").select(*key).distinct()
    return full.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def render(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of maximal conversations, in a chat template.

    The template's own markers in a turn are broken with a space, so no turn can pose as another."""
    each = prefixes(chats)
    kept = each.select("conv_id", "k", "role", "text").join(maximal(each), "conv_id")
    safe = [F.regexp_replace(c, r"<\|(im_start|im_end)\|>", r"<| $1 |>") for c in ("role", "text")]
    line = F.concat(F.lit(HEAD), safe[0], F.lit("\n"), safe[1], F.lit(TAIL), F.lit("\n"))
    rows = kept.withColumn("line", F.struct("k", line.alias("s")))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("line")), lambda x: x["s"]))
    return rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"), joined.alias("text"))
