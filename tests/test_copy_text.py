"""COPY text format round trip on the awkward cases (NULL, literal \\N, tab, newline,
carriage return, quote, brace, backslash, empty and NULL arrays, NULL elements)."""

import datetime as dt
import decimal

from pyspark.sql import types as T

from loomstat.sources import copy_text as CT

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("txt", T.StringType()), T.StructField("ok", T.BooleanType()),
    T.StructField("amount", T.DecimalType(12, 2)), T.StructField("ts", T.TimestampType()),
    T.StructField("d", T.DateType()), T.StructField("tags", T.ArrayType(T.StringType())),
])
ROWS = [
    (1, "plain", True, decimal.Decimal("10.50"), dt.datetime(2024, 1, 2, 3, 4, 5, 678901), dt.date(2024, 1, 2),
     ["a", "b"]),
    (2, None, False, None, None, None, None),
    (3, "\\N", None, decimal.Decimal("-0.01"), dt.datetime(2001, 8, 1), dt.date(2001, 8, 1), []),
    (4, "tab\there\nnew line\rcr", True, decimal.Decimal("1.00"), None, None, ['q"uote', "br{ace}", "back\\slash"]),
    (5, "back\\slash \\t not a tab", False, decimal.Decimal("0"), None, None, ["with,comma", None, "tab\tin"]),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "copy")
    CT.write_copy_text(df, path)
    back = CT.read_copy_text(spark, path, SCHEMA)
    got = sorted((tuple(r) for r in back.collect()), key=lambda r: r[0])
    assert got == [tuple(r) for r in ROWS]


def test_short_records_and_projection(spark, tmp_path):
    p = tmp_path / "short"
    p.mkdir()
    (p / "part.txt").write_text("7\thello\n8\n")
    back = CT.read_copy_text(spark, str(p), SCHEMA).orderBy("id").collect()
    assert back[0]["txt"] == "hello" and back[0]["ok"] is None and back[1]["txt"] is None
    proj = CT.project_columns(spark.createDataFrame([(1,)], "id long"), [("id", T.LongType()), ("x", T.StringType())])
    assert proj.columns == ["id", "x"] and proj.first()["x"] is None
