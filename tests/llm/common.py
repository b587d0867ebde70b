"""Small documents with the awkward cases every operator must handle."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, a string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward() -> list[tuple]:
    base = " ".join(f"w{i % 37}x{i * 7 % 101}" for i in range(160))
    texts = [
        "One plain sentence here. And another one follows it.",
        None,
        "",
        "   \n\t ",
        "One plain sentence here. And another one follows it.",
        "word " * 400,
        base,
        base + " tail words differ",
        base.replace("w5x", "w5y", 1),
        "x" * 5000,
        "Été naïve — “quotes” É b",
        "tab\tand  double  spaces\r\nand lines\n\n\nend",
        "long " + " ".join(f"t{i}" for i in range(30_000)),
        "<|endoftext|> is plain text",
        "a b c",
        "a b",
    ]
    rows = [(i, t, "en", "s0", len(t or ""), "clash", None) for i, t in enumerate(texts)]
    rows.append((4, texts[4], "en", "s0", 0, None, None))  # a repeated row
    rows.append((None, base, None, None, None, None, None))
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)
