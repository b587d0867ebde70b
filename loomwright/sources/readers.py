"""load(spec): a frame from a declared source. Kinds: csv, parquet, json, excel, sql, dataset."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError, UnknownName
from loomwright.operators.base import col
from loomwright.session import nan_to_null
from loomwright.sources import csv_text, xlsx

READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}
SUFFIXES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".xlsx": "excel"}
KEYS = {
    "csv": set(csv_text.DEFAULTS), "parquet": {"path", "columns", "filters"}, "json": {"path", "lines", "encoding", "record_path"}, "excel": {"path", "sheet", "header_row", "usecols"},
    "sql": {"url_env", "query", "options"}, "dataset": {"workspace", "role", "labeled", "version"},
}


def reader(kind: str):
    def add(f):
        READERS[kind] = f
        return f

    return add


def spec_of(source: str | dict) -> dict:
    """A path stands for the kind its suffix tells."""
    if isinstance(source, dict):
        return dict(source)
    suffix = os.path.splitext(source.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise UnknownName("file type", suffix, SUFFIXES)
    out = {"kind": SUFFIXES[suffix], "path": source}
    return out | {"lines": True} if suffix in (".jsonl", ".ndjson") else out


def load(spark: SparkSession, source: str | dict) -> DataFrame:
    """The source's frame, lazily; NaN is NULL. Options that its kind doesn't know are refused."""
    spec = spec_of(source)
    kind = spec.pop("kind", None)
    if kind not in READERS:
        raise UnknownName("source kind", str(kind), READERS)
    if extra := set(spec) - KEYS[kind]:
        raise UnknownName(f"option of a {kind} source", sorted(extra)[0], KEYS[kind])
    return nan_to_null(READERS[kind](spark, spec))


def source_columns(df: DataFrame) -> list[dict]:
    """Names and types, without a scan."""
    from loomwright.operators.base import NUMERIC

    return [{"name": f.name, "dtype": f.dataType.simpleString(), "numeric": isinstance(f.dataType, NUMERIC)} for f in df.schema if f.name != "_rid"]


READERS["csv"] = csv_text.read
READERS["excel"] = xlsx.read


@reader("parquet")
def parquet(spark, spec):
    """A file or a partitioned directory; columns and filters reach the scan."""
    df = spark.read.parquet(spec["path"])
    tests = {
        "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
    }
    for name, op, value in spec.get("filters") or ():
        if op not in tests:
            raise UnknownName("parquet filter", op, tests)
        df = df.where(tests[op](col(name), value))
    return df.select(*[col(c) for c in spec["columns"]]) if spec.get("columns") else df


def flat(df: DataFrame) -> DataFrame:
    """Objects to columns a_b, lists as they are."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        out = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                out += [col(f.name)[k.name].alias(f"{f.name}_{k.name}") for k in f.dataType]
            else:
                out.append(col(f.name))
        df = df.select(*out)
    if len(set(df.columns)) < len(df.columns):
        raise EngineError("two fields would share a column name")
    return df


@reader("json")
def json_(spark, spec):
    df = spark.read.option("multiLine", not spec.get("lines", False)).option("encoding", spec.get("encoding", "utf-8")).json(spec["path"])
    if path := spec.get("record_path"):
        records = F.col(".".join(f"`{k}`" for k in path.split(".")))
        df = df.select(F.explode(records).alias("r")).select("r.*")
    return flat(df)


@reader("sql")
def sql(spark, spec):
    """A query run by a database (the URL from an environment variable), or by Spark's catalog where none is named."""
    if not spec.get("url_env"):
        return spark.sql(spec["query"])
    url = os.environ.get(spec["url_env"])
    if not url:
        raise EngineError(f"environment variable {spec['url_env']!r} is not set")
    return spark.read.format("jdbc").options(url=url, query=spec["query"], **(spec.get("options") or {})).load()


@reader("dataset")
def dataset(spark, spec):
    """A workspace's frame after its steps."""
    from loomwright.plans.workspace import Workspace

    space = spec["workspace"] if isinstance(spec["workspace"], Workspace) else Workspace.open(spec["workspace"])
    return space.frame(spark, spec.get("role", "train"), spec.get("version"))
