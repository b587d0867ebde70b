"""Cleaning of text and of single values."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError
from loomwright.operators.base import NUMERIC, REQUIRED, col, kind, need, one_row, same_kind, transform, with_values

#: White space in the wide sense; ASCII trim alone is not enough.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def stripped(c):
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def unified(c):
    return F.regexp_replace(c, rf"(?:[-_.]|{SPACE})+", " ")


@transform("standardize_text", columns=REQUIRED, strip=True, lower=False, unify_separators=False, mapping={}, streamable=True)
def standardize_text(df, p, state):
    """Separators to one space, trim, lower case, then variants to their canonical form."""
    need(df, *p["columns"])
    out = {}
    for name in p["columns"]:
        x = col(name).cast("string")
        x = unified(x) if p["unify_separators"] else x
        x = stripped(x) if p["strip"] else x
        x = F.lower(x) if p["lower"] else x
        if p["mapping"]:
            table = F.create_map(*[F.lit(v) for pair in p["mapping"].items() for v in pair])
            x = F.coalesce(F.try_element_at(table, x), x)
        out[name] = x
    return with_values(df, out)


def numeric_text(x, decimal=".", thousands=None, percent=False):
    """The number that text writes, or NULL."""
    raw = stripped(x)
    shares = raw.endswith("%")
    raw = F.regexp_replace(raw, r"(?i)[$€£]|USD|EUR|GBP", "")
    raw = stripped(F.regexp_replace(raw, "%", ""))
    raw = F.regexp_replace(raw, r"[.,]-$", "")
    if thousands == " ":
        raw = F.regexp_replace(raw, SPACE, "")
    elif thousands:
        raw = F.regexp_replace(raw, re.escape(thousands), "")
    if decimal != ".":
        raw = F.regexp_replace(raw, re.escape(decimal), ".")
    value = F.when(raw.rlike(NUMBER), raw.try_cast("double"))
    return F.when(shares, value / 100).otherwise(value) if percent else value


@transform("to_numeric", columns=REQUIRED, decimal=".", thousands=None, percent=False, errors="coerce", streamable=True)
def to_numeric(df, p, state):
    """Text with currency, percent and thousands marks to doubles; other text is NULL, or raises when the plan runs."""
    need(df, *p["columns"])
    if p["decimal"] == p["thousands"]:
        raise EngineError("decimal and thousands marks must differ")
    out = {}
    for name in p["columns"]:
        if isinstance(kind(df, name), NUMERIC):
            out[name] = col(name).cast("double")
            continue
        value = numeric_text(col(name).cast("string"), p["decimal"], p["thousands"], p["percent"])
        if p["errors"] == "raise":
            value = F.when(col(name).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"column {name}: no number: "), col(name).cast("string"))).cast("double")).otherwise(value)
        out[name] = value
    return with_values(df, out)


def groups(pattern: str) -> tuple[str, list[str]]:
    """(the pattern for Java, names of its groups in order). All groups must be named."""
    if len(pattern) > 256:
        raise EngineError("a pattern has 256 characters at most")
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise EngineError(f"pattern: {error}") from error
    if not compiled.groupindex:
        raise EngineError("the pattern has no named group")
    names = [n for n, _ in sorted(compiled.groupindex.items(), key=lambda x: x[1])]
    return re.sub(r"\(\?P<\w+>", "(", pattern), [(n, compiled.groupindex[n]) for n in names]


def captured(df, p):
    java, names = groups(p["pattern"])
    x = col(p["column"]).cast("string")
    hit = x.rlike(java)
    return x, hit, {f"{p['prefix'] or p['column']}_{n}": F.when(hit, F.nullif(F.regexp_extract(x, java, i), F.lit(""))) for n, i in names}


def fit_extract(df, p):
    need(df, p["column"])
    _, _, found = captured(df, p)
    facts = [F.coalesce(F.every(v.rlike(NUMBER)), F.lit(False)).alias(k) for k, v in found.items()]
    return {"numeric": [k for k, yes in one_row(df, *facts).items() if yes]}


@transform("extract", fit=fit_extract, column=REQUIRED, pattern=REQUIRED, prefix=None, errors="coerce", streamable=True)
def extract(df, p, state):
    """Named groups of a pattern as columns; those that were all numbers at fit are doubles."""
    need(df, p["column"])
    x, hit, found = captured(df, p)
    out = {}
    for name, value in found.items():
        if p["errors"] == "raise":
            value = F.when(x.isNotNull() & ~hit, F.raise_error(F.concat(F.lit(f"column {p['column']}: no match: "), x)).cast("string")).otherwise(value)
        out[name] = F.when(value.rlike(NUMBER), value.try_cast("double")) if name in state.get("numeric", ()) else value
    return with_values(df, out)


@transform("replace_sentinels", sentinels=REQUIRED, streamable=True)
def replace_sentinels(df, p, state):
    """Listed values become NULL; values that can't equal the column's are passed over."""
    need(df, *p["sentinels"])
    out = {}
    for name, values in p["sentinels"].items():
        fit = [v for v in values if same_kind(kind(df, name), v)]
        out[name] = F.when(~col(name).isin(fit), col(name)) if fit else col(name)
    return with_values(df, out)


def typed_key(dtype, key: str):
    """A JSON key as a value of the column's type, None if it can't be one."""
    if isinstance(dtype, NUMERIC):
        try:
            return float(key)
        except ValueError:
            return None
    if isinstance(dtype, T.BooleanType):
        return {"true": True, "false": False, "1": True, "0": False}.get(str(key).strip().lower())
    return key


@transform("replace_values", mapping=REQUIRED, streamable=True)
def replace_values(df, p, state):
    """Old values to new ones, all at once; null means missing. Keys are read as the column's type."""
    need(df, *p["mapping"])
    out = {}
    for name, pairs in p["mapping"].items():
        dtype, x = kind(df, name), col(name)
        keys = [(typed_key(dtype, k), v) for k, v in pairs.items()]
        known = [k for k, _ in keys if k is not None]
        if len(set(known)) < len(known):
            raise EngineError(f"column {name!r}: two keys stand for one value")
        new = [v for k, v in keys if k is not None and v is not None]
        as_text = any(isinstance(v, str) for v in new) and not isinstance(dtype, T.StringType)
        numbers = isinstance(dtype, NUMERIC) and not as_text
        all_numbers = isinstance(dtype, T.StringType) and new and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in new)
        target = "string" if as_text or (isinstance(dtype, T.StringType) and not all_numbers) else "double" if numbers and any(isinstance(v, float) for v in new) else "string" if all_numbers else dtype
        value = x.cast(target) if target != dtype else x
        chain = None
        for key, v in keys:
            if key is None:
                continue
            hit, lit = x == F.lit(key), F.lit(v if not (target == "string" and v is not None) else str(v)).cast(target)
            chain = F.when(hit, lit) if chain is None else chain.when(hit, lit)
        out[name] = chain.otherwise(value) if chain is not None else value
    return with_values(df, out)
