"""Declared schemas: every rule is checked, the frame passes through."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import ContractViolation, EngineError
from loomwright.operators.base import NUMERIC, REQUIRED, RID, col, one_row, transform

MOST_FINDINGS = 200
RULE = {"name": None, "required": True, "dtype": None, "nullable": True, "max_missing_pct": None, "min": None, "max": None, "allowed": None, "unique": False}
KINDS = {"numeric": NUMERIC, "string": (T.StringType,), "category": (T.StringType,), "bool": (T.BooleanType,), "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType)}


def rules_of(p):
    out = []
    for given in p["columns"]:
        if extra := set(given) - set(RULE):
            raise EngineError(f"schema rule: unknown key {sorted(extra)[0]!r}")
        out.append(RULE | given)
    return out


def effective_kind(rule):
    if rule["dtype"] is None and any(isinstance(rule[k], (int, float)) and not isinstance(rule[k], bool) for k in ("min", "max")):
        return "numeric"
    return rule["dtype"]


def findings(df, p) -> list[dict]:
    """All violations, by one aggregate and one small query for each rule with examples."""
    rules, out = rules_of(p), []

    def found(rule, column, count, examples=()):
        out.append({"rule": rule, "column": column, "count": int(count), "examples": list(examples)})

    facts, checks = [F.count(F.lit(1)).alias("rows")], []
    for i, rule in enumerate(rules):
        name = rule["name"]
        if name not in df.columns:
            if rule["required"]:
                found("required", name, 1)
            continue
        wanted, dtype, x = effective_kind(rule), df.schema[name].dataType, col(name)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        if wanted and not isinstance(dtype, KINDS[wanted]):
            found("dtype", name, 1, [dtype.simpleString()])
            continue
        facts.append(F.count_if(x.isNull()).alias(f"null{i}"))
        for key, bad in (("min", lambda a, b: a < b), ("max", lambda a, b: a > b)):
            if rule[key] is not None:
                wrong = F.coalesce(bad(x, F.lit(rule[key]).cast(dtype if wanted == "datetime" else "double")), F.lit(False))
                facts.append(F.count_if(wrong).alias(f"{key}{i}"))
                checks.append((key, i, name, wrong))
        if rule["allowed"] is not None:
            wrong = x.isNotNull() & ~F.coalesce(x.isin(rule["allowed"]), F.lit(False))
            facts.append(F.count_if(wrong).alias(f"allowed{i}"))
            checks.append(("allowed", i, name, wrong))
        if rule["unique"]:
            facts.append((F.count(x) - F.count_distinct(x)).alias(f"unique{i}"))
    row = one_row(df, *facts)
    total = row["rows"]
    for i, rule in enumerate(rules):
        missing = row.get(f"null{i}")
        if missing is None:
            continue
        if not rule["nullable"] and missing:
            found("nullable", rule["name"], missing)
        if rule["max_missing_pct"] is not None and total and 100 * missing / total > rule["max_missing_pct"]:
            found("max_missing_pct", rule["name"], missing)
        if rule["unique"] and row[f"unique{i}"]:
            found("unique", rule["name"], row[f"unique{i}"])
    for key, i, name, wrong in checks:
        if row[f"{key}{i}"]:
            few = df.where(wrong).select(col(name).cast("string")).distinct().orderBy(F.asc(name)).limit(p["max_examples"]).collect()
            found(key, name, row[f"{key}{i}"], [r[0] for r in few])
    if p["min_rows"] is not None and total < p["min_rows"]:
        found("min_rows", None, total)
    if p["max_rows"] is not None and total > p["max_rows"]:
        found("max_rows", None, total)
    if p["extra_columns"] == "warn":
        known = {r["name"] for r in rules}
        out += [{"rule": "extra_column", "column": c, "count": 1, "examples": []} for c in df.columns if c not in known and c != RID]
    return out[:MOST_FINDINGS]


def fit_contract(df, p):
    counts: dict[str, int] = {}
    for f in findings(df, p):
        counts[f["rule"]] = counts.get(f["rule"], 0) + 1
    return {"violations": counts}


@transform("expected_schema", fit=fit_contract, columns=REQUIRED, schema_version=1, on_violation="report", max_examples=5, extra_columns="ignore", min_rows=None, max_rows=None)
def expected_schema(df, p, state):
    if p["on_violation"] == "error" and (wrong := findings(df, p)):
        raise ContractViolation(f"{len(wrong)} rules don't hold, the first: {wrong[0]['rule']} of {wrong[0]['column']}")
    return df


def findings_frame(df, params) -> object:
    """The findings as a frame (rule, column, count, examples)."""
    from loomwright.operators.base import get

    rows = [(f["rule"], f["column"], f["count"], ", ".join(map(str, f["examples"]))) for f in findings(df, get("expected_schema").params(params))]
    return df.sparkSession.createDataFrame(rows, "rule string, column string, count long, examples string")
