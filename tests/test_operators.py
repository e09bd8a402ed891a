import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import compat, text
from lodestone.operators import graph, quality
from lodestone.sources import tables
from lodestone.streaming import replay


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_compat_scalars(spark):
    s = F.lit("abc")
    assert [one(spark, compat.substr(s, k, 2)) for k in (0, 1, 2)] == ["a", "ab", "bc"]
    assert one(spark, compat.scalar_max(F.lit(1), F.lit(None).cast("int"))) is None and one(spark, compat.scalar_min(F.lit(1), F.lit(2))) == 1
    assert one(spark, compat.divide(F.lit(1), F.lit(0))) is None
    assert one(spark, compat.close_to(F.lit(1e15), F.lit(1e15 + 500))) and not one(spark, compat.close_to(F.lit(1.0), F.lit(1.1)))


def test_text_functions(spark):
    df = spark.createDataFrame([("el 3 de Mayo de 2024, sesión", "Café  con\nleche ")], "a string, b string")
    r = df.select(text.spanish_date(F.col("a")).alias("d"), text.normalize_text(F.col("b")).alias("n"), text.slug(F.lit("¡Señor Águila!")).alias("s"), text.year_of(F.col("a")).alias("y"), text.spanish_date(F.lit("1 de foo de 2020")).alias("none")).first()
    assert (r.d, r.n, r.s, r.y, r.none) == ("2024-05-03", "Café con leche", "senor-aguila", 2024, "")
    assert one(spark, F.lit("Él dijo SESIÓN").rlike(text.accent_insensitive_pattern("sesion")))
    w = spark.createDataFrame([("a b c d", "a x c"), ("", "")], "t string, o string").select(text.word_error_rate("t", "o").alias("w"), text.token_prf("t", "o").alias("p")).collect()
    assert w[0].w == 0.5 and w[1].w == 0.0 and w[0].p.recall == 0.5 and w[0].p.precision == pytest.approx(2 / 3) and w[1].p.f1 == 1.0
    assert one(spark, text.span_recall(F.array(F.lit("Ab"), F.lit("zz")), F.lit("xABy"))) == 0.5


def test_structured_tables(spark, tmp_path):
    cell = lambda a, v=None: {"address": a, "data_type": "n", "number_format": "General", "value": v}
    doc = {"format": tables.FORMAT, "source_sha256": "0" * 64, "sheets": [{"ordinal": 1, "name": "S", "state": "visible", "max_row": 2, "max_column": 2, "merged_ranges": ["A1:B1"], "rows": [
        [cell("A1", {"type": "string", "value": "k"}), cell("B1")], [cell("A2", {"type": "integer", "value": "99999999999999999999"}), cell("B2", {"type": "boolean", "value": "true"})]]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    docs = tables.structured_tables(spark, str(tmp_path / "d.json"))
    got = tables.projections(docs)
    rows = got["sheet_1_rows"].orderBy("row_index").collect()
    assert got["projection_sheets"].first().merged_ranges_json == '["A1:B1"]' and rows[0].c1_text == "k" and rows[0].c2_kind == "blank"
    assert rows[1].c1_integer is None and rows[1].c1_text == "99999999999999999999" and rows[1].c2_boolean is True
    assert tables.cells(docs).count() == 4
    doc["sheets"][0]["max_column"] = 3
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(tables.SourceError):
        tables.structured_tables(spark, str(tmp_path / "bad.json"))


def test_csv_spec_object_store_and_reports(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("k;name;ok\n1;Años;true\n;;0\n".encode("windows-1252"))
    df = tables.specified_csv(spark, str(tmp_path / "x.csv"), [("k", "integer"), ("name", "string"), ("ok", "boolean")], "windows-1252", ";", 2)
    assert [tuple(r) for r in df.collect()] == [(1, "Años", True), (None, None, False)]
    with pytest.raises(tables.SourceError):
        tables.specified_csv(spark, str(tmp_path / "x.csv"), [("k", "integer"), ("name", "string"), ("ok", "boolean")], "windows-1252", ";", 3)
    objects = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"%PDF-1"),), (bytearray(b"PK\3\4"),)], "content binary")
    tables.store_objects(spark, objects, str(tmp_path / "store"))
    tables.store_objects(spark, objects, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert {r[0] for r in objects.select(tables.file_type(F.col("content"))).collect()} == {"pdf", "zip"}
    tables.write_report(df, str(tmp_path / "md"), "markdown")
    assert "| 1 | Años | true |" in [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]


def test_graph_and_results(spark):
    e = spark.createDataFrame([("C", "B"), ("B", "A"), ("B", "A"), ("A", "Z")], "src string, dst string")
    got = {(r.node, r.depth) for r in graph.reach(e, spark.createDataFrame([("C",)], "node string"), 2).collect()}
    assert got == {("C", 0), ("B", 1), ("A", 2)}
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(x, "A") for x in "ABCZ"}
    a = spark.createDataFrame([(1, 1, "number", "1.0"), (1, 2, "string", "x"), (2, 1, "integer", "3")], "row int, col int, kind string, value string")
    b = spark.createDataFrame([(1, 1, "integer", "1"), (1, 2, "string", "y")], "row int, col int, kind string, value string")
    assert {(r.row, r.col) for r in quality.compare_cells(a, b).collect()} == {(1, 2), (2, 1)}


def test_stream_replay_is_idempotent_and_detects_collisions(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "id bigint, digest string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(src)
    run = lambda: replay.replay_into(spark.readStream.schema(schema).parquet(src), out, ck, "id", "digest")
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    spark.createDataFrame([(3, "other")], schema).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="another payload"):
        run()
