"""The registry of transforms: fit learns a JSON-safe state on one frame, apply rewrites any frame's plan.

fit runs at most a few aggregate actions; apply is lazy unless an operator's documentation says that
it must look at the frame's own rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError, MissingColumn, UnknownName

RID = "_rid"
REQUIRED = object()
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

TRANSFORMS: dict[str, Transform] = {}


@dataclass(frozen=True)
class Transform:
    name: str
    defaults: dict
    apply_fn: Callable
    fit_fn: Callable | None = None
    streamable: bool = False
    notes: str = field(default="", compare=False)

    def params(self, given: dict | None) -> dict:
        given = dict(given or {})
        if extra := [k for k in given if k not in self.defaults]:
            raise UnknownName(f"parameter of {self.name}", extra[0], self.defaults)
        out = {k: given.get(k, v) for k, v in self.defaults.items()}
        if lacking := [k for k, v in out.items() if v is REQUIRED]:
            raise EngineError(f"{self.name}: parameter {lacking[0]!r} is required")
        return out

    def fit(self, df: DataFrame, params: dict | None = None) -> dict:
        state = self.fit_fn(df, self.params(params)) if self.fit_fn else {}
        json.dumps(state)
        return state

    def apply(self, df: DataFrame, params: dict | None = None, state: dict | None = None) -> DataFrame:
        return self.apply_fn(df, self.params(params), state or {})

    def fit_apply(self, df: DataFrame, params: dict | None = None) -> DataFrame:
        return self.apply(df, params, self.fit(df, params))


def transform(op: str, /, *, fit: Callable | None = None, streamable: bool = False, **defaults):
    """Register apply(df, params, state) under a name; defaults give its parameters."""

    def add(apply: Callable) -> Callable:
        TRANSFORMS[op] = Transform(op, defaults, apply, fit, streamable, (apply.__doc__ or "").strip())
        return apply

    return add


def get(name: str) -> Transform:
    if name not in TRANSFORMS:
        raise UnknownName("transform", name, TRANSFORMS)
    return TRANSFORMS[name]


def need(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise MissingColumn(name, df.columns)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    """A numeric column as double, NaN as NULL."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def kind(df: DataFrame, name: str) -> T.DataType:
    need(df, name)
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), NUMERIC)


def numeric_columns(df: DataFrame, *without: str | None) -> list[str]:
    return [c for c in df.columns if c != RID and c not in without and is_numeric(df, c)]


def need_numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(df, name):
            raise EngineError(f"column {name!r} is not numeric")


def with_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """All new values computed from the frame as it is, existing columns in place, new ones last."""
    old = [values[c].alias(c) if c in values else col(c) for c in df.columns]
    return df.select(*old, *(v.alias(c) for c, v in values.items() if c not in df.columns))


def no_clash(df: DataFrame, *names: str) -> None:
    for name in names:
        if name in df.columns:
            raise EngineError(f"column {name!r} exists already")


def unique_names(names: list[str]) -> list[str]:
    if len(set(names)) < len(names):
        twice = next(n for n in names if names.count(n) > 1)
        raise EngineError(f"two columns would be named {twice!r}")
    return names


def row_order(df: DataFrame) -> list[Column]:
    """The frame's own order: _rid where it has one."""
    return [F.col(RID)] if RID in df.columns else []


def one_row(df: DataFrame, *exprs: Column) -> dict:
    return df.agg(*exprs).first().asDict() if exprs else {}


def literal(value) -> Column:
    return F.lit(value)


def same_kind(dtype: T.DataType, value) -> bool:
    """Whether a literal can equal a value of the column's type: text never equals a number."""
    if value is None:
        return False
    if isinstance(dtype, NUMERIC):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    return isinstance(value, str)
