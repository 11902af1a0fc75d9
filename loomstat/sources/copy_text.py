"""PostgreSQL ``COPY ... (FORMAT text, NULL '\\N')`` bulk files, read and written in parallel.

Format: one record per line, fields separated by TAB, ``\\N`` is NULL, backslash escapes
``\\\\ \\t \\n \\r`` inside fields, booleans ``t``/``f``, ISO dates and timestamps, and
arrays as ``{"a","b"}`` (elements double-quoted, ``\\"`` and ``\\\\`` escaped).
Reading is ``spark.read.text`` + built-in string functions per field (no Python per row);
a CSV reader cannot do this: quoting must be off and the escapes would stay unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TOKEN = "\\N"
_PLACEHOLDER = "\ue000"  # private-use code point standing in for an escaped backslash while unescaping
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, "\t", r"\\t")
    c = F.regexp_replace(c, "\n", r"\\n")
    return F.regexp_replace(c, "\r", r"\\r")


def _unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit(_PLACEHOLDER))
    c = F.replace(c, F.lit("\\t"), F.lit("\t"))
    c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    c = F.replace(c, F.lit("\\r"), F.lit("\r"))
    return F.replace(c, F.lit(_PLACEHOLDER), F.lit("\\"))


def _field_text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        s = F.when(c, F.lit("t")).otherwise(F.lit("f"))
    elif isinstance(t, T.TimestampType):
        s = F.date_format(c, TS_FORMAT)
    elif isinstance(t, T.DateType):
        s = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(t, T.ArrayType):
        quoted = F.transform(c, lambda x: F.when(x.isNull(), F.lit("NULL")).otherwise(
            F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))))
        s = F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))
    else:
        s = c.cast("string")
    return F.when(c.isNull(), F.lit(NULL_TOKEN)).otherwise(_escape(s))


def to_copy_text(df: DataFrame) -> DataFrame:
    """One ``value`` column per record, ready for ``write.text`` (S3 column order = ``df.columns``)."""
    return df.select(F.concat_ws("\t", *[_field_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
                     .alias("value"))


def write_copy_text(df: DataFrame, path: str) -> None:
    to_copy_text(df).write.mode("overwrite").text(path)


def _parse(raw: Column, t: T.DataType) -> Column:
    v = _unescape(raw)
    if isinstance(t, T.ArrayType):
        # array literal: elements are "quoted" (with \\ and \" escapes, which are JSON escapes
        # too) or bare words, where a bare NULL (any case) is a NULL element
        body = F.regexp_extract(v, r"(?s)^\{(.*)\}$", 1)
        items = F.regexp_extract_all(body, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[^,]+)'), 1)
        str_t = T.ArrayType(T.StringType())

        def element(e):
            decoded = F.from_json(F.concat(F.lit("["), e, F.lit("]")), str_t,
                                  {"allowUnquotedControlChars": "true"}).getItem(0)
            val = F.when(e.startswith('"'), decoded).when(F.upper(F.trim(e)) == "NULL", F.lit(None).cast("string")) \
                .otherwise(F.trim(e))
            return val.cast(t.elementType)

        return F.when(raw.isNull(), F.lit(None).cast(t)).otherwise(F.transform(items, element))
    if isinstance(t, T.BooleanType):
        return F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(v.isin("t", "true", "1"))
    if isinstance(t, T.TimestampType):
        return F.coalesce(F.to_timestamp(v, TS_FORMAT), F.to_timestamp(v))
    if isinstance(t, T.DateType):
        return F.to_date(v)
    return v.cast(t)


def read_copy_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read COPY text files with an explicit schema (column order as in ``schema``).
    A record with fewer fields than the schema gets NULLs for the missing ones (S3)."""
    parts = F.split(F.col("value"), "\t", -1)
    cols = []
    for i, f in enumerate(schema.fields):
        raw = F.when(F.size(parts) > i, F.element_at(parts, i + 1))
        raw = F.when(raw == F.lit(NULL_TOKEN), F.lit(None).cast("string")).otherwise(raw)
        cols.append(_parse(raw, f.dataType).alias(f.name))
    return spark.read.text(path).select(*cols)


def project_columns(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    """S3: fixed column order for a load; absent columns become typed NULLs."""
    have = set(df.columns)
    return df.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in columns])
