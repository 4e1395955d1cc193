"""CSV ingest: all fields are read as text, checked, and then converted by Spark.

Blank rows are skipped; a row with too many or too few fields, a missing column or a bad value raises before
anything is published; empty strings stay empty strings. Files are read in splits, but for those in which a
quoted field holds a line end: these are read whole, a task for each file.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import tagged as T

_BAD = "__malformed"
#: What no field is, so that no field is read as null.
_NEVER = "\u0001\u0002never\u0002\u0001"


def has_open_quotes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a line leaves a quote open, so that a field goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.option("encoding", encoding).text(path).filter(quotes % 2 == 1).limit(1).count())


def _first_line(spark: SparkSession, path: str, encoding: str) -> str:
    rows = spark.read.option("encoding", encoding).text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    return rows[0][0] if rows else ""


def read_text_columns(spark: SparkSession, path: str, columns: list[str] | None, header: bool, delimiter: str, encoding: str) -> DataFrame:
    """The columns asked for, in that order, as text."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    if not header and not columns:
        raise ValueError("a file without a header needs columns")
    if columns and len(set(columns)) < len(columns):
        raise ValueError("a column is named twice")
    names = columns or []
    if header:
        line = _first_line(spark, path, encoding)
        if not line:
            raise ValueError("the file has no header")
        names = next(csv.reader([line.removeprefix("﻿")], delimiter=delimiter))
        if len(set(names)) < len(names):
            raise ValueError("the header names a column twice")
        missing = [c for c in columns or [] if c not in names]
        if missing:
            raise ValueError(f"the header lacks {', '.join(missing)}")
    schema = StructType([*(StructField(n, StringType()) for n in names), StructField(_BAD, StringType())])
    raw = (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", has_open_quotes(spark, path, encoding))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .option("enforceSchema", True)
        .option("nullValue", _NEVER)
        .option("emptyValue", "")
        .csv(path)
    )
    checked = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
    first = F.when(F.col(_BAD).isNotNull(), F.raise_error(F.concat(F.lit("a row has too many or too few fields: "), F.col(_BAD)))).otherwise(checked)
    rows = raw.withColumn(names[0], first)
    wanted = columns or names
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in wanted))


def as_boolean(text: Column, what: str) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit(f"{what} is no boolean: "), text)).cast("boolean"))


def as_number(text: Column, kind: str, what: str) -> Column:
    value = F.expr(f"try_cast(trim(`{what}`) AS {kind})")
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{what} is no {kind}: "), text)).cast(kind)).otherwise(value)


def tagged_value(column: str, kind: str) -> Column:
    """A text column as tagged values of a declared type: string, integer, real or boolean."""
    text = F.col(f"`{column}`")
    if kind == "string":
        return T.as_tagged(text, kind)
    if kind == "boolean":
        return T.as_tagged(as_boolean(text, column), kind)
    if kind in ("integer", "real"):
        return T.as_tagged(as_number(text, T.SPARK_TYPES[kind], column), kind)
    raise ValueError(f"unsupported property type {kind!r}")


def property_map(columns: list[str], types: dict[str, str]) -> Column:
    for c in types:
        if c not in columns:
            raise ValueError(f"a type is given for {c!r}, which is no property")
    if not columns:
        return F.create_map().cast(T.PROPS)
    return F.create_map(*(x for c in columns for x in (F.lit(c), tagged_value(c, types.get(c, "string"))))).cast(T.PROPS)
