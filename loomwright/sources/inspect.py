"""What a file is, before it is loaded: how it is written, what it offers to read, and a spec that load() takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomwright.sources import csv_text, xlsx
from loomwright.sources.readers import load, source_columns, spec_of

#: Lines that are shown as they are.
SHOWN = 10


def record_paths(schema: T.StructType, above: str = "") -> list[str]:
    """Fields that hold lists of objects, by their dotted path."""
    out = []
    for f in schema:
        path = f"{above}.{f.name}" if above else f.name
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(path)
        elif isinstance(f.dataType, T.StructType):
            out += record_paths(f.dataType, path)
    return out


def inspect(spark: SparkSession, source: str | dict | DataFrame) -> dict:
    """kind, load_spec, facts (name, value), offers (sheets or record paths), lines (raw) and the columns that the spec gives."""
    if isinstance(source, DataFrame):
        return {"kind": "frame", "load_spec": None, "facts": [], "offers": [], "lines": [], "columns": source_columns(source)}
    spec = spec_of(source)
    facts, offers, lines = {}, [], []
    if spec["kind"] == "csv":
        raw = csv_text.head(spark, spec["path"])
        encoding = csv_text.guess_encoding(raw)
        text = raw.decode(encoding, errors="replace").lstrip(chr(0xFEFF))
        sep = csv_text.sniff_delimiter(text)
        junk = csv_text.junk_lines(text, sep)
        widths = {len(r) for r in csv_text.records(text[: text.rfind("\n") + 1] or text, sep)[junk:] if r}
        facts = {"encoding": encoding, "sep": sep, "decimal": csv_text.guess_decimal(text, sep), "junk_lines": junk, "fields": max(widths, default=0), "ragged": len(widths) > 1, "files": len(csv_text.parts(spark, spec["path"]))}
        lines = text.splitlines()[:SHOWN]
        spec |= {k: facts[k] for k in ("encoding", "sep", "decimal")} | ({"skiprows": junk} if junk else {}) | ({"on_bad_lines": "skip"} if len(widths) > 1 else {})
    elif spec["kind"] == "json":
        opened = csv_text.head(spark, spec["path"], 4096).decode("utf-8", errors="replace").lstrip()
        first = opened.split("\n", 1)[0].rstrip()
        if "lines" not in spec and first.startswith("{") and first.endswith("}") and "\n{" in opened:
            spec["lines"] = True
        schema = spark.read.option("multiLine", not spec.get("lines", False)).json(spec["path"]).schema
        offers = [{"record_path": p} for p in record_paths(schema)]
        facts = {"lines": spec.get("lines", False), "top": "list" if opened.startswith("[") else "object"}
        if len(offers) == 1 and not spec.get("lines", False) and facts["top"] == "object" and "record_path" not in spec:
            spec["record_path"] = offers[0]["record_path"]
        lines = opened.splitlines()[:SHOWN]
    elif spec["kind"] == "excel":
        raw = csv_text.head(spark, spec["path"], xlsx.MOST_BYTES + 1)
        for name in xlsx.sheets(raw):
            rows = xlsx.cells(raw, name)
            offers.append({"sheet": name, "rows": len(rows), "columns": max(map(len, rows), default=0)})
        full = [o for o in offers if o["rows"]]
        facts = {"sheets": len(offers)}
        if full and "sheet" not in spec:
            spec["sheet"] = full[0]["sheet"]
    elif spec["kind"] == "parquet":
        df = spark.read.parquet(spec["path"])
        facts = {"files": len(df.inputFiles()), "rows": df.count()}
    return {"kind": spec["kind"], "load_spec": spec, "facts": [{"name": k, "value": str(v)} for k, v in facts.items()], "offers": offers, "lines": lines, "columns": source_columns(load(spark, spec))}
