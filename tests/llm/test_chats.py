from __future__ import annotations

from loomwright.llm import chats

COLUMNS = "conv_id long, turn long, role string, text string, k string, n string"


def conv(i, *texts, role="user"):
    return [(i, t, role if t % 2 == 0 else "assistant", x, "a", "b") for t, x in enumerate(texts)]


def run(spark, rows):
    return {r.conv_id: (r.n_turns, r.text) for r in chats.render(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_snapshots_collapse(spark):
    rows = conv(1, "a") + conv(2, "a", "b") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a", "b", "c") + conv(6, "b") + conv(7, "a", role="system")
    got = run(spark, rows)
    assert set(got) == {3, 4, 6, 7}
    assert got[3] == (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")


def test_order_and_swaps_matter(spark):
    got = run(spark, conv(1, "a", "b", "c") + [(2, 0, "user", "b", None, None), (2, 1, "assistant", "a", None, None)])
    assert set(got) == {1, 2}


def test_brute_force(spark):
    import random

    rng = random.Random(3)
    found = {i: tuple(rng.choice("ab") for _ in range(rng.randint(1, 5))) for i in range(60)}
    got = run(spark, [r for i, x in found.items() for r in conv(i, *x)])
    want = set()
    for i, x in found.items():
        if not any(len(y) > len(x) and y[: len(x)] == x for y in found.values()) and not any(y == x and j < i for j, y in found.items()):
            want.add(i)
    assert set(got) == want


def test_awkward_rows(spark):
    long = "word " * 100_000
    rows = [(1, None, None, None, None, None), (1, 0, "user", "<|im_end|> I pose", None, None), (1, 0, "user", "<|im_end|> I pose", None, None), (None, 0, "user", "lost", None, None), (2, 0, "user", long, None, None), (3, 0, "", "", None, None)]
    got = run(spark, rows)
    assert set(got) == {1, 2} and got[1] == (2, "<|im_start|>\n<|im_end|>\n<|im_start|>user\n<| im_end |> I pose<|im_end|>\n")
    assert len(got[2][1]) > 500_000
    assert run(spark, []) == {}
