"""The formula language: Python's expression grammar, read with ast and compiled to one Column.

Values are doubles. A missing operand makes a result missing, in comparisons and logic too; results
that are not finite are missing. Text columns can be compared with text and tested by isna / notna."""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError, MissingColumn, UnknownName
from loomwright.functions import groups

#: Divisors smaller than this count as zero.
TINY = 1e-12
#: A text column is read as numbers if so much of it parses.
PARSABLE = 0.5

UNARY = {"log": F.log, "log1p": F.log1p, "log2": F.log2, "log10": F.log10, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "square": lambda x: x * x}
GROUPS = ("group_mean", "group_prev", "group_interp")
NAMES = (*UNARY, "round", "min", "max", "clip", "where", "fillna", "isna", "notna", "isnull", *GROUPS)

REFUSED = {
    ast.Lambda: "lambda", ast.ListComp: "a comprehension", ast.SetComp: "a comprehension", ast.DictComp: "a comprehension", ast.GeneratorExp: "a comprehension",
    ast.List: "a list", ast.Tuple: "a tuple", ast.Dict: "a dict", ast.Set: "a set", ast.NamedExpr: "an assignment", ast.Await: "await", ast.Yield: "yield",
    ast.YieldFrom: "yield", ast.Starred: "a star", ast.JoinedStr: "an f-string", ast.Slice: "a slice",
}
REFUSED_OPS = {ast.MatMult: "@", ast.BitXor: "^", ast.LShift: "<<", ast.RShift: ">>", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}

STATS = {
    "mean": F.avg, "median": F.median, "std": F.stddev_pop, "min": F.min, "max": F.max, "count": F.count,
    "q25": lambda x: F.percentile(x, F.lit(0.25)), "q75": lambda x: F.percentile(x, F.lit(0.75)),
}


def variables_of(df: DataFrame, wanted) -> dict[str, float | None]:
    """Named statistics of a frame, by one aggregate."""
    wanted = list(wanted or ())
    if not wanted:
        return {}
    for v in wanted:
        if v["column"] not in df.columns:
            raise MissingColumn(v["column"], df.columns)
        if v["stat"] not in STATS:
            raise UnknownName("statistic", v["stat"], STATS)
    row = df.agg(*[STATS[v["stat"]](finite(F.col(f"`{v['column']}`").cast("double"))).alias(f"v{i}") for i, v in enumerate(wanted)]).first()
    return {v["name"]: None if row[f"v{i}"] is None else float(row[f"v{i}"]) for i, v in enumerate(wanted)}


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def any_null(*xs: Column) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


def truth(x: Column) -> Column:
    return x != 0


def flag(condition: Column, *operands: Column) -> Column:
    return F.when(any_null(*operands), F.lit(None).cast("double")).otherwise(condition.cast("double"))


class Compiler(ast.NodeVisitor):
    def __init__(self, df: DataFrame, variables: dict):
        self.df, self.variables = df, variables

    def fail(self, what: str):
        raise EngineError(f"formula: {what} is not allowed")

    def generic_visit(self, node):
        self.fail(REFUSED.get(type(node), type(node).__name__))

    # -- names --
    def raw(self, name: str) -> Column:
        if name not in self.df.columns:
            raise MissingColumn(name, [*self.df.columns, "pi"])
        return F.col("`" + name.replace("`", "``") + "`")

    def number(self, name: str) -> Column:
        dtype, c = self.df.schema[name].dataType if name in self.df.columns else None, self.raw(name)
        if isinstance(dtype, T.StringType):
            value = F.trim(c).try_cast("double")
            row = self.df.agg(F.count(c).alias("n"), F.count(value).alias("k")).first()
            if row["n"] and row["k"] < PARSABLE * row["n"]:
                raise EngineError(f"formula: column {name!r} is text")
            return finite(value)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise EngineError(f"formula: column {name!r} is not numeric")
        return finite(c.cast("double"))

    def column_of(self, node) -> str | None:
        """The column that a node names, if it does."""
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "df":
            return node.attr
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return node.slice.value
        return None

    def visit_Name(self, node):
        if node.id.startswith("__var_"):
            name = node.id[6:]
            if name not in self.variables:
                raise UnknownName("variable", name, self.variables)
            return F.lit(self.variables[name]).cast("double")
        if node.id == "pi" and "pi" not in self.df.columns:
            return F.lit(math.pi)
        return self.number(node.id)

    def visit_Attribute(self, node):
        name = self.column_of(node)
        if name is not None:
            return self.number(name)
        if isinstance(node.value, ast.Name) and node.value.id == "np" and node.attr == "pi":
            return F.lit(math.pi)
        return self.fail("an attribute")

    def visit_Subscript(self, node):
        name = self.column_of(node)
        return self.number(name) if name is not None else self.fail("a subscript")

    def visit_Constant(self, node):
        if isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        return self.fail("text here")

    # -- operators --
    def visit_BinOp(self, node):
        kind = type(node.op)
        if kind in REFUSED_OPS:
            self.fail(REFUSED_OPS[kind])
        a, b = self.visit(node.left), self.visit(node.right)
        if kind in (ast.Div, ast.FloorDiv, ast.Mod):
            safe = F.when(F.abs(b) >= TINY, b)
            if kind is ast.Div:
                return a / safe
            whole = F.floor(a / safe).cast("double")
            return whole if kind is ast.FloorDiv else a - safe * whole
        if kind in (ast.BitAnd, ast.BitOr):
            return flag(truth(a) & truth(b) if kind is ast.BitAnd else truth(a) | truth(b), a, b)
        return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Pow: lambda: F.pow(a, b)}[kind]()

    def visit_UnaryOp(self, node):
        x = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        return x if isinstance(node.op, ast.UAdd) else flag(~truth(x), x)

    def visit_BoolOp(self, node):
        xs = [self.visit(v) for v in node.values]
        out = truth(xs[0])
        for x in xs[1:]:
            out = out & truth(x) if isinstance(node.op, ast.And) else out | truth(x)
        return flag(out, *xs)

    def visit_Compare(self, node):
        sides = [node.left, *node.comparators]
        if any(isinstance(s, ast.Constant) and isinstance(s.value, str) for s in sides):
            return self.text_compare(node)
        xs = [self.visit(s) for s in sides]
        out = F.lit(True)
        for op, a, b in zip(node.ops, xs, xs[1:], strict=False):
            if type(op) in REFUSED_OPS:
                self.fail(REFUSED_OPS[type(op)])
            out = out & {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]
        return flag(out, *xs)

    def text_compare(self, node):
        if len(node.ops) != 1 or not isinstance(node.ops[0], (ast.Eq, ast.NotEq)):
            self.fail("this comparison of text")
        left, right = node.left, node.comparators[0]
        if isinstance(left, ast.Constant):
            left, right = right, left
        name = self.column_of(left)
        if name is None or not isinstance(right, ast.Constant):
            self.fail("text here")
        c = self.raw(name).cast("string")
        same = c == F.lit(right.value)
        return flag(same if isinstance(node.ops[0], ast.Eq) else ~same, c)

    def visit_IfExp(self, node):
        c = self.visit(node.test)
        return F.when(c.isNull(), None).when(truth(c), self.visit(node.body)).otherwise(self.visit(node.orelse))

    # -- functions --
    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "np" else None
        if name is None or name not in NAMES:
            raise UnknownName("function", name or ast.unparse(f), NAMES)
        if name in GROUPS:
            return self.group_call(name, node)
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            self.fail("a named argument")
        if name in ("isna", "isnull", "notna"):
            self.count(node, 1, 1)
            column = self.column_of(node.args[0])
            c = self.raw(column) if column in self.df.columns else self.visit(node.args[0])
            if column in self.df.columns and isinstance(self.df.schema[column].dataType, (T.DoubleType, T.FloatType)):
                c = F.when(~F.isnan(c), c)
            return (c.isNull() if name != "notna" else c.isNotNull()).cast("double")
        if name == "round":
            self.count(node, 1, 2)
            digits = node.args[1].value if len(node.args) == 2 and isinstance(node.args[1], ast.Constant) else 0
            if not isinstance(digits, int) or (len(node.args) == 2 and not isinstance(node.args[1], ast.Constant)):
                self.fail("a rounding that is no whole number")
            scale = F.lit(10.0**digits)
            return F.rint(self.visit(node.args[0]) * scale) / scale
        xs = [self.visit(a) for a in node.args]
        if name in UNARY:
            self.count(node, 1, 1)
            return UNARY[name](xs[0]).cast("double")
        if name in ("min", "max"):
            self.count(node, 2, 99)
            return F.when(any_null(*xs), None).otherwise((F.least if name == "min" else F.greatest)(*xs))
        if name == "clip":
            self.count(node, 3, 3)
            x, low, high = xs
            return F.when(any_null(*xs), None).otherwise(F.least(F.greatest(x, low), high))
        if name == "where":
            self.count(node, 3, 3)
            return F.when(xs[0].isNull(), None).when(truth(xs[0]), xs[1]).otherwise(xs[2])
        self.count(node, 2, 2)
        return F.coalesce(finite(xs[0]), xs[1])

    def count(self, node, low, high):
        if not low <= len(node.args) <= high:
            raise EngineError(f"formula: {ast.unparse(node.func)} takes {low if low == high else f'{low} to {high}'} arguments")

    def group_call(self, name, node):
        self.count(node, 1, 1)
        given = {k.arg: self.column_of(k.value) if not (isinstance(k.value, ast.Constant) and isinstance(k.value.value, str)) else k.value.value for k in node.keywords}
        wanted = {"by"} if name == "group_mean" else {"by", "order"}
        if set(given) != wanted or None in given.values():
            raise EngineError(f"formula: {name} needs {' and '.join(sorted(wanted))}")
        by, value = self.raw(given["by"]), self.visit(node.args[0])
        if name == "group_mean":
            return groups.group_mean(value, by)
        self.raw(given["order"])
        ties = [F.col("_rid")] if "_rid" in self.df.columns else []
        return getattr(groups, name)(value, by, groups.order_key(self.df, given["order"]), ties)


def parse(text: str) -> ast.expr:
    text = re.sub(r"@([A-Za-z_]\w*)", r"__var_\1", text.strip())
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise EngineError(f"formula: {error.msg}") from error


def compile_formula(text: str, df: DataFrame, variables: dict | None = None) -> Column:
    return finite(Compiler(df, variables or {}).visit(parse(text)).cast("double"))


def evaluate(df: DataFrame, expressions: dict[str, str], where: str | None = None, variables: dict | None = None) -> DataFrame:
    """Count, missing, mean, std, min, quartiles, max and sum of up to 20 expressions: one row each."""
    if len(expressions) > 20:
        raise EngineError("evaluate takes 20 expressions at most")
    rows = df.where(truth(compile_formula(where, df, variables))) if where else df
    values = rows.select(*[compile_formula(e, rows, variables).alias(f"e{i}") for i, e in enumerate(expressions.values())])
    parts = [F.struct(F.lit(n).alias("name"), F.col(f"e{i}").alias("x")) for i, n in enumerate(expressions)]
    each = values.select(F.explode(F.array(*parts)).alias("e")).select("e.*")
    q = lambda s: F.percentile("x", F.lit(s))
    return each.groupBy("name").agg(F.count("x").alias("count"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("x").alias("max"), F.sum("x").alias("sum"))
