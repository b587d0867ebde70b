"""CSV facts from the head of a file: encoding, delimiter, decimal mark, where the header stands.

Only the head is read on the driver, through Spark's own file access, so any store that Spark reads
will do. Rows are read and typed by Spark."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.errors import EngineError
from loomwright.operators.text import NUMBER
from loomwright.session import with_rid

SAMPLE = 64 * 1024
DELIMITERS = (",", ";", "\t", "|")
#: Texts that mean a missing value.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DEFAULTS = {
    "path": None, "sep": "auto", "encoding": "auto", "decimal": "auto", "skiprows": 0, "header": True, "mixed_sep": "error", "na_values": (), "dtype": {}, "parse_dates": (), "usecols": None,
    "on_bad_lines": "error", "keep_leading_zeros": True,
}
ROW = "__row"


def head(spark: SparkSession, path: str, size: int = SAMPLE) -> bytes:
    """The first bytes of a file, or of a folder's first file, through Hadoop's file system."""
    jvm, where = spark._jvm, parts(spark, path)[0]
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def parts(spark: SparkSession, path: str) -> list:
    """A path's files: itself, or those of a folder but for marks and hidden ones."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.getFileStatus(where).isDirectory():
        return [where]
    found = sorted((s.getPath() for s in files.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "_."), key=lambda p: p.getName())
    if not found:
        raise EngineError(f"{path}: no file")
    return found


def guess_encoding(raw: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name
    for name in ("utf-8", "cp1252"):
        try:
            raw[:-4].decode(name) if len(raw) >= SAMPLE else raw.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def records(text: str, sep: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text), delimiter=sep))


def sniff_delimiter(text: str) -> str:
    """The candidate with which most rows share one field count of two or more."""
    best, most = ",", (0, 0)
    for sep in DELIMITERS:
        widths = Counter(len(r) for r in records(text, sep) if r)
        wide = {w: n for w, n in widths.items() if w >= 2}
        if wide:
            width = max(wide, key=lambda w: (wide[w], w))
            if (wide[width], width) > most:
                best, most = sep, (wide[width], width)
    return best


def guess_decimal(text: str, sep: str) -> str:
    if sep == ",":
        return "."
    cells = [c.strip() for r in records(text, sep) for c in r]
    commas, points = (sum(bool(re.fullmatch(rf"[+-]?\d+{re.escape(m)}\d+", c)) for c in cells) for m in ",.")
    return "," if commas > points else "."


def junk_lines(text: str, sep: str) -> int:
    """Lines before the header: the first record as wide as most of the second half."""
    rows = records(text, sep)
    half = [len(r) for r in rows[len(rows) // 2 :] if r]
    if not half:
        return 0
    usual = Counter(half).most_common(1)[0][0]
    return next((i for i, r in enumerate(rows) if len(r) == usual), 0)


def header_line(text: str, sep: str, skip: int) -> int:
    """The physical line on which a record begins."""
    reader, at = csv.reader(io.StringIO(text), delimiter=sep), 0
    for _ in range(skip):
        next(reader, None)
        at = reader.line_num
    return at


def read(spark: SparkSession, spec: dict) -> DataFrame:
    """A CSV with all its columns typed: bigint, double, boolean, timestamp_ntz (parse_dates) or string; _rid is the line's place."""
    p = DEFAULTS | spec
    raw = head(spark, p["path"])
    encoding = guess_encoding(raw) if p["encoding"] == "auto" else p["encoding"]
    text = raw.decode(encoding, errors="replace").lstrip("﻿")
    text = text[: text.rfind("\n") + 1] or text
    sep = sniff_delimiter(text) if p["sep"] == "auto" else p["sep"]
    skip = junk_lines(text, sep) if p["skiprows"] == "auto" else p["skiprows"]
    decimal = guess_decimal(text, sep) if p["decimal"] == "auto" else p["decimal"]
    rows = records(text, sep)[skip:]
    if not rows:
        raise EngineError(f"{p['path']}: no row")
    names = [c.strip() for c in rows[0]] if p["header"] else [f"c{i}" for i in range(len(rows[0]))]
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise EngineError(f"{p['path']}: column {twice[0]!r} stands twice in the header")
    # Blank records have no fields for Python's reader but are lines all the same.
    first = header_line(text, sep, skip)
    if encoding.lower().replace("-", "") in ("utf8", "ascii"):
        source = spark.read.text(p["path"])
    else:  # the text source knows UTF-8 alone; the CSV one decodes, and passes over blank lines
        source = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", "iso-8859-1" if encoding == "cp1252" else encoding).csv(p["path"])
        if encoding == "cp1252":  # Spark's charsets lack it: Latin-1 but for 32 control characters
            pairs = [(chr(b), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))]
            source = source.select(F.translate("value", *("".join(x) for x in zip(*pairs, strict=True))).alias("value"))
        first = sum(bool(line.strip()) for line in text.splitlines()[:first])
    lines = with_rid(source, ROW).where(F.col(ROW) >= first + bool(p["header"]))
    lines = lines.where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", "\r$", ""))
    if p["header"] and len(parts(spark, p["path"])) > 1:  # every file of a folder has the header
        lines = lines.where(F.col("value") != text.splitlines()[first])
    lines = mixed_separators(lines, sep, p)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("__bad", T.StringType())])
    parsed = lines.select(F.col(ROW), F.from_csv("value", _ddl(schema), {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r")).select(ROW, "r.*")
    parsed = bad_lines(parsed, lines, sep, len(names), p)
    keep = [n for n in names if p["usecols"] is None or n in p["usecols"]]
    return typed(parsed, keep, decimal, p).withColumnRenamed(ROW, "_rid")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def mixed_separators(lines: DataFrame, sep: str, p: dict) -> DataFrame:
    """Lines that hold another separator but not the file's: an error, rewritten, or left."""
    if p["mixed_sep"] == "ignore":
        return lines
    other = [s for s in DELIMITERS if s != sep]
    plain = ~F.contains("value", F.lit(sep)) & ~F.contains("value", F.lit('"'))
    odd = plain & F.greatest(*[F.contains("value", F.lit(s)).cast("int") for s in other]).cast("boolean")
    if p["mixed_sep"] == "normalize":
        return lines.withColumn("value", F.when(odd, F.translate("value", "".join(other), sep * len(other))).otherwise(F.col("value")))
    found = [r[ROW] + 1 for r in lines.where(odd).orderBy(ROW).limit(5).collect()]
    if found:
        raise EngineError(f"{p['path']}: lines {found} use another separator than {sep!r}")
    return lines


def bad_lines(parsed: DataFrame, lines: DataFrame, sep: str, width: int, p: dict) -> DataFrame:
    broken = F.col("__bad").isNotNull()
    if p["on_bad_lines"] == "error":
        found = [r[ROW] + 1 for r in parsed.where(broken).orderBy(ROW).limit(5).collect()]
        if found:
            raise EngineError(f"{p['path']}: lines {found} have not {width} fields")
    return parsed.where(~broken).drop("__bad")


def typed(df: DataFrame, names: list[str], decimal: str, p: dict) -> DataFrame:
    """Types from the whole of every column, by one aggregate."""
    missing = (*MISSING_TEXTS, *p["na_values"])
    cell = {n: F.when(~F.trim(F.col(f"`{n}`")).isin(*missing), F.trim(F.col(f"`{n}`"))) for n in names}
    number = {n: F.regexp_replace(c, ",", ".") if decimal == "," else c for n, c in cell.items()}
    facts = []
    for i, n in enumerate(names):
        facts += [
            F.every(cell[n].rlike(r"^[+-]?\d{1,18}$")).alias(f"int{i}"), F.every(number[n].rlike(NUMBER)).alias(f"num{i}"),
            F.every(F.lower(cell[n]).isin("true", "false")).alias(f"bool{i}"), F.coalesce(F.some(cell[n].rlike(r"^0\d+$")), F.lit(False)).alias(f"zero{i}"),
        ]
    row = df.agg(*facts).first()
    out = [F.col(ROW)]
    for i, n in enumerate(names):
        wanted = p["dtype"].get(n)
        if n in p["parse_dates"]:
            value = cell[n].cast("timestamp_ntz")
        elif wanted:
            from loomwright.operators.columns import TYPES

            value = (number[n] if TYPES.get(wanted, wanted) in ("double", "float") else cell[n]).cast(TYPES.get(wanted, wanted))
        elif row[f"int{i}"] and not (row[f"zero{i}"] and p["keep_leading_zeros"]):
            value = cell[n].try_cast("bigint")
        elif row[f"num{i}"] and not (row[f"zero{i}"] and p["keep_leading_zeros"]):
            value = number[n].try_cast("double")
        elif row[f"bool{i}"]:
            value = F.lower(cell[n]).try_cast("boolean")
        else:
            value = F.when(~F.col(f"`{n}`").isin(*missing), F.col(f"`{n}`"))
        out.append(value.alias(n))
    return df.select(*out)
