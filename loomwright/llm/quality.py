"""Quality rules with thresholds learned for each language and source.

Every document gets counts (one pass, whole texts). Each ratio's distribution is kept as a mergeable
quantile sketch: counts of logarithmic buckets, exact to 1 % of a value, merged by adding counts, so
any split of the rows gives the same sketch. Sketches of (lang, source) merge into those of lang and
of all rows; a group of under LEAST_DOCS documents takes the next wider one. A threshold is an outer
fence, upper quartile + FENCE x spread. The spread counts as some least width, so that an even source
doesn't reject harmless tails; a guard rail above keeps a source full of junk from vouching for itself."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.text import MIX, Words, slices, window_hashes, window_ok
from loomwright.session import bounded_broadcast, ship, spread_small

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30

GAMMA = 1.02
LEAST_DOCS = 200
FENCE = 6.0
#: Threshold tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 50_000


@dataclass(frozen=True)
class Rule:
    """A ratio (numerator / denominator) that fails beyond its threshold: at least `width` above its group's upper quartile, at most high."""

    name: str
    numerator: str
    denominator: str
    width: float
    high: float


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", 0.04, 0.30),
    Rule("dup_line_share", "n_dup_lines", "n_lines", 0.50, 0.80),
    Rule("word_length", "word_chars", "n_words", 2.0, 60.0),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS)] = True
_BLANK = b" \t\n\r\x0b\x0c"


def repeated_words(words: Words, n: int = WINDOW) -> np.ndarray:
    """Per text: words in n-word windows that the text has twice or more, the first included."""
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(window_ok(words, n))
    if len(at):
        key = window_hashes(words.hashes(), n)[at] + (words.doc[at] + 1).astype(np.uint64) * MIX
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return total[words.bounds[1:]] - total[words.bounds[:-1]]


def lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    own = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(own), len(own) - len(set(own))


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(texts)
    pairs = np.array([lines(t) for t in texts], dtype=np.int64).reshape(len(texts), 2)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": words.per_text(words.inside & ((words.data & 0xC0) != 0x80)),
        "n_symbols": words.per_text(_symbol[words.data]),
        "n_lines": pairs[:, 0],
        "n_dup_lines": pairs[:, 1],
        "n_repeat_words": repeated_words(words),
    }


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns keep of every row, and its counts under names with two leading underscores."""
    ship(docs.sparkSession)
    rows = spread_small(docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text")), f"`{keep[0]}`")
    fields = [rows.schema[c].simpleString().split(":", 1)[1] for c in keep]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, fields, strict=True)), *(f"__{c} bigint" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("__text")):
                found = counts(texts)
                own = [batch.column(c).slice(first, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*keep, *(f"__{c}" for c in COUNTS)])

    return rows.mapInArrow(run, schema)


def ratio(rule: Rule):
    top, below = F.col(f"__{rule.numerator}"), F.col(f"__{rule.denominator}")
    return F.when(below > 0, top / below)


def base_failed():
    n = F.col("__n_words")
    return (n < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEAT_PERCENT * n)


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of every ratio for each language and source.

    Rows that fail the base rules don't count: they are no example of their source."""
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), ratio(r).alias("value")) for r in RULES])
    each = counted.where(~base_failed()).select("lang", "source", F.explode(values).alias("v")).select("lang", "source", "v.*")
    bucket = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / math.log(GAMMA)).cast("int"))
    return each.where("value IS NOT NULL").withColumn("bucket", bucket).groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, rule, docs, q25, q75) of merged sketches; a value stands for the middle of its bucket."""
    group = W.partitionBy(*by, "rule")
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5), F.lit(0.0))
    ranked = sketches.withColumn("docs", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("value", value)
    picks = [F.min(F.when(F.col("upto") >= p * F.col("docs"), F.col("value"))).alias(name) for p, name in ((0.25, "q25"), (0.75, "q75"))]
    return ranked.groupBy(*by, "rule").agg(F.max("docs").alias("docs"), *picks)


def limit():
    """The fence of a row of quartiles, at most its rule's guard rail."""
    spread = FENCE * (F.col("q75") - F.col("q25"))
    out = F.lit(None).cast("double")
    for rule in RULES:
        out = F.when(F.col("rule") == rule.name, F.least(F.lit(rule.high), F.col("q75") + F.greatest(F.lit(rule.width), spread))).otherwise(out)
    return out


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, one column for each rule): a group's own threshold, else its language's, else that of all."""
    fine = quartiles(sketches, "lang", "source").select("lang", "source", "rule", F.when(F.col("docs") >= LEAST_DOCS, limit()).alias("own"))
    by_lang = quartiles(merge(sketches, "lang"), "lang").select(F.col("lang").alias("l"), F.col("rule").alias("r"), F.when(F.col("docs") >= LEAST_DOCS, limit()).alias("wider"))
    whole = quartiles(merge(sketches)).select(F.col("rule").alias("w"), limit().alias("widest"))
    joined = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("r"))).join(F.broadcast(whole), F.col("rule") == F.col("w"))
    pick = F.coalesce("own", "wider", "widest")
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r.name, pick)).alias(f"__max_{r.name}") for r in RULES])


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with __base_failed and __kept. A group without thresholds has no row that passes the base."""
    limits = bounded_broadcast(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}), MOST_BROADCAST)
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    verdict = ~base_failed()
    for rule in RULES:
        verdict &= F.coalesce(ratio(rule) <= F.col(f"__max_{rule.name}"), F.lit(True))
    return joined.withColumn("__base_failed", base_failed()).withColumn("__kept", verdict).drop("__lang", "__source")
