"""URL filters: host-suffix and path-prefix expressions against a list of rules.

A url stands for every pair of a suffix of its host (at label borders) and a prefix of its path (at
slashes). Expressions meet rules in an equi-join on a short prefix of their digest; the full digest
then confirms a hit, and so does the rest of a rule's path after its last slash. The longest rule
wins: more characters of host and path, then a longer host, then block before allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dealing import join_counted
from loomwright.session import bounded_broadcast

#: Hex digits of the digest that the join compares.
SHORT = 8
#: Rule lists of up to so many rows (some 200 bytes each) are broadcast; longer ones are joined by a shuffle.
MOST_BROADCAST = 100_000

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column) -> Column:
    """The prefixes that end in a slash, and the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix).cast("binary"), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with digests; a row with a null is no rule."""
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna()
    head = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)
    known = known.withColumn("rule_digest", digest(F.col("rule_host"), head))
    return known.withColumn("short", F.substring("rule_digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of pages as (page_id, host, path, rule, verdict); rule is null where none fits.

    A null url, or one without ://, has an empty host and path, and rules fit it only if their own
    are empty. Repeated rows are judged each. Urls are judged once for each distinct host and path, and
    a url that very many rows have (or that they lack) is no hot key: join_counted."""
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    known = bounded_broadcast(rule_table(rules), MOST_BROADCAST)
    pairs = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    each = pairs.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix")).select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"))).alias("prefix"))
    each = each.withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, SHORT))
    hits = each.join(known, "short").where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    best = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    won = hits.groupBy("host", "path").agg(F.max(best).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    judged = pairs.join(won, ["host", "path"], "left")
    return join_counted(rows, judged, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
