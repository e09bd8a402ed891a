"""Sources and sinks: Parquet tables, specified CSV, structured-table documents, payloads, object store, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([T.StructField("address", T.StringType()), T.StructField("data_type", T.StringType()), T.StructField("number_format", T.StringType()), T.StructField("value", T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))])
SHEET = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("name", T.StringType()), T.StructField("state", T.StringType()), T.StructField("max_row", T.LongType()), T.StructField("max_column", T.LongType()), T.StructField("merged_ranges", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(CELL)))])
DOCUMENT = T.StructType([T.StructField("format", T.StringType()), T.StructField("source_sha256", T.StringType()), T.StructField("sheets", T.ArrayType(SHEET))])
FORMAT = "lodestone.structured_table.v1"


class SourceError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code = code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structured_tables(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the structured-table format; malformed ones raise."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ordinals = F.transform("sheets", lambda s: s["ordinal"])
    bad_order = F.exists(F.sequence(F.lit(1), F.size("sheets") - 1), lambda i: F.get(ordinals, i) <= F.get(ordinals, i - 1)) & (F.size("sheets") > 1)
    bad_shape = F.exists("sheets", lambda s: (F.size(s["rows"]) != s["max_row"]) | F.exists(s["rows"], lambda r: F.size(r) != s["max_column"]))
    bad = docs.where((F.col("format") != FORMAT) | F.col("format").isNull() | ~F.col("source_sha256").rlike("^[0-9a-f]{64}$") | bad_order | bad_shape)
    if not bad.isEmpty():
        raise SourceError("structured_table_invalid", path)
    return docs


def cells(docs: DataFrame) -> DataFrame:
    """Flat cells: sheet_ordinal, sheet_name, row, column (from 1), address, data_type, number_format, kind, value."""
    sheets = docs.select(F.explode("sheets").alias("s"))
    rows = sheets.select("s.ordinal", "s.name", F.posexplode("s.rows").alias("r", "cells"))
    flat = rows.select("ordinal", "name", "r", F.posexplode("cells").alias("c", "cell"))
    return flat.select(F.col("ordinal").alias("sheet_ordinal"), F.col("name").alias("sheet_name"), (F.col("r") + 1).alias("row"), (F.col("c") + 1).alias("column"), "cell.address", "cell.data_type", "cell.number_format", F.coalesce("cell.value.type", F.lit("blank")).alias("kind"), F.col("cell.value.value").alias("value"))


def facets(kind: Column, value: Column, prefix: str) -> list[Column]:
    """Typed facets of a cell value; integers out of 64 bits stay in the text facet only."""
    v = value.cast("string")
    return [
        kind.alias(f"{prefix}_kind"), F.when(kind != "blank", v).alias(f"{prefix}_text"),
        F.when(kind == "integer", v.try_cast("bigint")).alias(f"{prefix}_integer"), F.when(kind.isin("integer", "number"), v.try_cast("double")).alias(f"{prefix}_number"),
        F.when(kind == "boolean", v.try_cast("boolean")).alias(f"{prefix}_boolean"), F.when(kind == "datetime", v).alias(f"{prefix}_datetime"), F.when(kind == "formula", v).alias(f"{prefix}_formula"),
    ]


def projections(docs: DataFrame) -> dict[str, DataFrame]:
    """projection_sheets and one wide sheet_<n>_rows per sheet, selected without a shuffle."""
    heads = docs.select(F.explode("sheets").alias("s")).select("s.ordinal", "s.name", "s.state", "s.max_row", "s.max_column", F.to_json("s.merged_ranges").alias("merged_ranges_json"))
    out = {"projection_sheets": heads}
    for h in heads.collect():  # one row per sheet
        rows = docs.select(F.explode("sheets").alias("s")).where(F.col("s.ordinal") == h.ordinal).select(F.posexplode("s.rows").alias("r", "cells"))
        cols = [(F.col("r") + 1).cast("bigint").alias("row_index")]
        for k in range(h.max_column):
            c = F.get("cells", F.lit(k))
            cols += facets(F.coalesce(c["value"]["type"], F.lit("blank")), c["value"]["value"], f"c{k + 1}")
            cols += [c[f].alias(f"c{k + 1}_{f}") for f in ("address", "data_type", "number_format")]
        out[f"sheet_{h.ordinal}_rows"] = rows.select(*cols)
    return out


def coerce(raw: Column, kind: str) -> Column:
    """CSV text to a kind: '' is null; what does not parse raises."""
    v = F.nullif(raw, F.lit(""))
    if kind == "string":
        return v
    if kind == "boolean":
        low = F.lower(v)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(v.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), v)).cast("boolean"))
    return v.cast({"integer": "bigint", "number": "double"}[kind])


def specified_csv(spark: SparkSession, path: str, columns: list[tuple[str, str]], encoding: str = "UTF-8", delimiter: str = ",", row_count: int | None = None) -> DataFrame:
    """CSV under a frozen spec: header equality, kinds and, if given, the number of rows."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in columns])
    cp1252 = encoding.lower() in ("windows-1252", "cp1252")  # Spark reads its superset, the C1 codes follow
    encoding = "ISO-8859-1" if cp1252 else encoding
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, encoding=encoding, sep=delimiter, mode="FAILFAST", multiLine=True, nullValue="\0")
    if row_count is not None and df.count() != row_count:
        raise SourceError("row_count_mismatch", path)
    codes = "".join(map(chr, (c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))
    plain = lambda c: F.translate(c, codes, codes.encode("latin-1").decode("cp1252")) if cp1252 else c
    return df.select(*[coerce(plain(F.col(n)), k).alias(n) for n, k in columns])


def file_type(content: Column) -> Column:
    """Type by magic bytes."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304"), "zip").when(h.startswith("D0CF11E0A1B11AE1"), "ole").when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg").otherwise("unknown")


def store_objects(spark: SparkSession, objects: DataFrame, path: str, content_col: str = "content") -> DataFrame:
    """Append unseen contents to a content-addressed table (sha256, size, content); returns the new ones."""
    new = objects.select(F.sha2(content_col, 256).alias("sha256"), F.octet_length(content_col).alias("size"), F.col(content_col).alias("content")).dropDuplicates(["sha256"])
    try:
        known = spark.read.parquet(path).select("sha256")
        new = new.join(known, "sha256", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy().parquet(path)
    return new.select("sha256", "size")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV, JSON lines or a Markdown table."""
    if kind == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "value string").coalesce(1)
        head.unionByName(df.select(line.alias("value"))).write.mode("overwrite").text(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))


#: Keys under which services wrap their records, in order.
ENVELOPES = ("results", "result", "data", "records", "items")


def unwrapped(payload: Column, item: str) -> Column:
    """The records of an API page as an array of ``item``: a list, or an object that holds one under a known key, one
    more level down at most; null if there is none."""
    of = f"array<{item}>"
    listed = lambda x: F.when(F.ltrim(x).startswith("["), F.from_json(x, of))
    found = [listed(payload)]
    for key in ENVELOPES:
        inner = F.get_json_object(payload, f"$.{key}")
        found += [listed(inner), *[listed(F.get_json_object(inner, f"$.{k}")) for k in ENVELOPES]]
    return F.coalesce(*found)


def list_of_lists(payload: Column) -> Column:
    """Rows of a header-first list of lists as an array of maps; null if it is none."""
    rows = F.when(F.ltrim(payload).rlike(r"^\[\s*\["), F.from_json(payload, "array<array<string>>"))
    return F.when(F.size(rows) > 0, F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: F.map_from_arrays(rows[0], r)))


def pages_until_repeat(pages: DataFrame, key: str, page: str, payload: str, boundaries: list[int]) -> DataFrame:
    """(key, pages, repeated, at_boundary): pages up to the first that repeats the one before, and whether their
    number is one at which services stop."""
    w = Window.partitionBy(key).orderBy(page)
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    marked = pages.withColumn("_r", (digest == F.lag(digest).over(w)).cast("int"))
    marked = marked.withColumn("_s", F.coalesce(F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = marked.groupBy(key).agg(F.count_if(F.col("_s") == 0).alias("pages"), (F.max("_s") == 1).alias("repeated"))
    return out.withColumn("at_boundary", F.col("pages").isin(boundaries))


def workbook_audit(sheets: DataFrame, file: str, rows: str) -> DataFrame:
    """(file, sheets, data_rows, most, status) from rows (file, rows of one sheet, its header included)."""
    out = sheets.groupBy(file).agg(F.count("*").alias("sheets"), F.sum(F.greatest(F.col(rows) - 1, F.lit(0))).alias("data_rows"), F.max(rows).alias("most"))
    return out.withColumn("status", F.when(F.col("data_rows") > 0, "has_data").otherwise("empty"))
