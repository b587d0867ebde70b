from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright import catalogue_io
from loomwright.errors import EngineError
from loomwright.operators import get
from loomwright.pipeline import pipeline
from loomwright.plans.workspace import Workspace, changes, page, preview, removed
from loomwright.session import with_rid
from loomwright.sources import export, load, source_columns
from loomwright.sources.inspect import inspect
from loomwright.streaming import score_stream, windowed_counts


def csv(tmp_path, text, **spec):
    path = tmp_path / "x.csv"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return {"kind": "csv", "path": str(path), **spec}


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("_rid").collect()]


def test_csv_types_and_marks(spark, tmp_path):
    df = load(spark, csv(tmp_path, 'id;price;name;code;ok\n1;1,5;"a;b";007;true\n2;2,25;NA;008;false\n3;;c;009;\n'))
    assert rows(df) == [(1, 1.5, "a;b", "007", True), (2, 2.25, None, "008", False), (3, None, "c", "009", None)]
    assert [c["dtype"] for c in source_columns(df)] == ["bigint", "double", "string", "string", "boolean"]


def test_csv_junk_header_and_encoding(spark, tmp_path):
    df = load(spark, csv(tmp_path, "Report, of, many, things\n\nmade by us\nid,name,qty\n1,\xe9t\xe9,3\n2,b,4\n3,c,5\n".encode("cp1252"), skiprows="auto", mixed_sep="ignore"))
    assert rows(df) == [(1, "été", 3), (2, "b", 4), (3, "c", 5)]


def test_csv_mixed_separators_and_bad_lines(spark, tmp_path):
    text = "id,name,qty\n1,a,2\n2;b;3\n3,c,4\n4,d,5\n"
    with pytest.raises(EngineError, match="another separator"):
        load(spark, csv(tmp_path, text))
    assert len(rows(load(spark, csv(tmp_path, text, mixed_sep="normalize")))) == 4
    bad = "id,name\n1,a\n2,b,c\n3,d\n"
    with pytest.raises(EngineError, match="fields"):
        load(spark, csv(tmp_path, bad))
    assert rows(load(spark, csv(tmp_path, bad, on_bad_lines="skip"))) == [(1, "a"), (3, "d")]
    with pytest.raises(EngineError, match="twice"):
        load(spark, csv(tmp_path, "a,a\n1,2\n"))
    with pytest.raises(EngineError):
        load(spark, csv(tmp_path, "a,b\n1,2\n", separator=","))


def test_parquet_filters_reach_the_scan(spark):
    df = load(spark, {"kind": "parquet", "path": "/root/testdata/sf0.001/orders.parquet", "columns": ["o_orderkey"], "filters": [["o_totalprice", ">", 1000.0]]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and df.columns == ["o_orderkey"]


def test_json_records(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"data": {"items": [{"a": 1, "b": {"c": "x", "d": [1, 2]}}, {"a": 2, "b": {"c": None, "d": []}}]}}))
    df = load(spark, {"kind": "json", "path": str(path), "record_path": "data.items"})
    assert df.columns == ["a", "b_c", "b_d"] and df.count() == 2


def test_workbook(spark, tmp_path):
    path = tmp_path / "x.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="A3"><v>2</v></c></row></sheetData></worksheet>')
    assert rows(load(spark, str(path))) == [(1, "x"), (2, None)]


def facts(found):
    return {f["name"]: f["value"] for f in found["facts"]}


def test_inspect_csv(spark, tmp_path):
    path = csv(tmp_path, "made by us\nid;price;name\n1;2,5;a\n2;3,75;b;c\n3;1,0;d\n".encode("cp1252"))["path"]
    found = inspect(spark, path)
    assert facts(found) == {"encoding": "utf-8", "sep": ";", "decimal": ",", "junk_lines": "1", "fields": "4", "ragged": "True", "files": "1"}
    assert found["load_spec"] == {"kind": "csv", "path": path, "encoding": "utf-8", "sep": ";", "decimal": ",", "skiprows": 1, "on_bad_lines": "skip"} and found["lines"][0] == "made by us"
    assert [(c["name"], c["dtype"]) for c in found["columns"]] == [("id", "bigint"), ("price", "double"), ("name", "string")] and load(spark, found["load_spec"]).count() == 2


def test_inspect_json_and_parquet(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"meta": {"n": 1}, "data": {"items": [{"a": 1}, {"a": 2}]}}, indent=1))
    found = inspect(spark, str(path))
    assert found["offers"] == [{"record_path": "data.items"}] and load(spark, found["load_spec"]).count() == 2
    lined = tmp_path / "y.json"
    lined.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    found = inspect(spark, str(lined))
    assert found["load_spec"]["lines"] is True and load(spark, found["load_spec"]).count() == 3
    found = inspect(spark, "/root/testdata/sf0.001/nation.parquet")
    assert facts(found) == {"files": "1", "rows": "25"} and found["kind"] == "parquet"


def space(spark):
    train = spark.createDataFrame([(i, float(i), "a" if i % 2 else "b") for i in range(10)], "_rid long, v double, c string")
    test = spark.createDataFrame([(0, 100.0, "a"), (1, None, "z")], "_rid long, v double, c string")
    return Workspace("w", {"train": train, "test": test}).add("impute", {"columns": ["v"]}).add("scale", {"columns": ["v"]}).add("filter_rows", {"conditions": [{"column": "v", "op": "gt", "value": 0}]}, "train").add("onehot", {"columns": ["c"]})


def test_replay_fits_on_train(spark):
    frames, states = space(spark).replay(spark)
    assert states[0]["values"]["v"] == 4.5 and states[1]["v"][0] == 4.5
    assert frames["train"].count() == 5 and frames["test"].columns == ["_rid", "v", "c_a", "c_b"]
    assert frames["test"].orderBy("_rid").collect()[1].v == 0.0
    assert space(spark).frame(spark, "test", version=1).columns == ["_rid", "v", "c"]


def test_preview_and_pages(spark):
    w = space(spark)
    seen = preview(w, spark, "clip", {"columns": ["v"], "lower": 0, "upper": 50})
    assert seen["cells"].count() == 2 and seen["removed"].count() == 0 and seen["added"] == []
    df = w.raw(spark, "train")
    assert [r.v for r in page(df, 2, 3, sort=["v"], ascending=False).collect()] == [7.0, 6.0, 5.0]
    after = df.where("v < 8").withColumn("v", F.when(F.col("v") == 3, 33.0).otherwise(F.col("v")))
    assert [tuple(r) for r in changes(df, after).select("_rid", "column").collect()] == [(3, "v")] and removed(df, after).count() == 2


def test_failing_step_is_named(spark):
    with pytest.raises(EngineError, match=r"step 1 \(scale\)"):
        Workspace("w", {"train": spark.range(3).withColumnRenamed("id", "_rid")}).add("scale", {"columns": ["v"]}).replay(spark)


def test_export(spark, tmp_path):
    manifest = export(space(spark), spark, str(tmp_path / "out"))
    assert len(manifest["files"]) == 2 and spark.read.parquet(manifest["files"][0]).columns == ["v", "c_a", "c_b"]


def test_saved_and_opened(spark, tmp_path):
    w = Workspace("w", {"train": {"kind": "parquet", "path": "/root/testdata/sf0.001/orders.parquet"}}).add("drop_columns", {"columns": ["o_orderdate"]})
    w.save(str(tmp_path / "w.json"))
    df = load(spark, {"kind": "dataset", "workspace": str(tmp_path / "w.json")})
    assert "o_orderdate" not in df.columns and df.agg(F.max("_rid") - F.count("*") + 1).first()[0] == 0


def test_ml_pipeline(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    model = pipeline([{"op": "impute", "params": {"columns": ["v"]}}, {"op": "scale", "params": {"columns": ["v"]}}]).fit(df)
    assert [r.v for r in model.transform(df).collect()][1] == 0.0


def test_ml_stages_bounds_by_value(spark, tmp_path):
    """As its SQL has it: quantities are cut at 40, whatever share of them lies above, then scaled."""
    values = [1.0, 10.0, 39.0, 40.0, 41.0, 50.0, 50.0]
    lines = spark.createDataFrame([(k, 1, k, k, v) for k, v in enumerate(values)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    cut = [min(v, 40.0) for v in values]
    mean = sum(cut) / len(cut)
    std = (sum((v - mean) ** 2 for v in cut) / len(cut)) ** 0.5
    got = {r.l_orderkey: r.l_quantity for r in catalogue_io.ml_stages(spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx((v - mean) / std, abs=1e-4) for k, v in enumerate(cut)}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(10)], "v double, c string").withColumn("t", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    batch.write.parquet(folder)
    steps = [{"op": "scale", "params": {"columns": ["v"]}}, {"op": "onehot", "params": {"columns": ["c"]}}]
    states = [get(s["op"]).fit(batch, s["params"]) for s in steps]
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    for name, out, mode, n in (("scored", score_stream(stream, steps, states), "append", 10), ("counted", windowed_counts(stream, "t", "c"), "complete", 2)):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    with pytest.raises(EngineError):
        score_stream(stream, [{"op": "sort_rows", "params": {"by": ["v"]}}], [{}])


def test_rids_are_dense(spark):
    df = with_rid(spark.range(1000).repartition(7))
    assert sorted(r._rid for r in df.collect()) == list(range(1000))


def test_rids_of_a_sorted_wide_frame(spark):
    """The job that counts rows reads fewer bytes than the one that numbers them, and may have fewer partitions."""
    wide = F.concat(*[F.sha2(F.concat("id", F.lit(k)).cast("string"), 512) for k in range(8)])
    df = spark.range(20_000).select(F.col("id").alias("_rid"), ((F.col("id") * 7919) % 20_000).alias("v"), wide.alias("payload"))
    rows = with_rid(get("sort_rows").fit_apply(df, {"by": ["v"], "ascending": False}), "place").select("v", "place", F.length("payload").alias("n"), F.hash("payload").alias("h")).collect()
    assert all(r.place == 19_999 - r.v and r.n == 1024 for r in rows) and len(rows) == 20_000
