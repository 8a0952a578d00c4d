"""Rows from outside: headerless CSV and Python dictionaries."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from typing import IO, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import Array, Struct, Type, to_spark, to_storage

#: Fixed value: how CSV cells say NULL.
NULL_CELL = "NULL"


def _cell(col: Column, t: Type) -> Column:
    """A cell's text as ``t``; arrays are comma lists in one quoted cell."""
    value = F.when((col == NULL_CELL) | (col == ""), F.lit(None)).otherwise(col)
    if isinstance(t, Array):
        if isinstance(t.element, Struct):
            raise ValueError(f"Arrays of {t.element} are not supported")
        return F.split(value, ",").cast(to_spark(t))
    return value.cast(to_spark(t))


def read_csv(spark: SparkSession, source: str | IO[Any], fields: list[tuple[str, Type]]) -> DataFrame:
    """Columns by position. A path is read by Spark's tasks; an open file is in the driver already and goes out from there."""
    names = [f"s{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(x, T.StringType()) for x in names])
    if isinstance(source, str):
        text = spark.read.csv(source, schema=schema, header=False, quote='"', escape='"', multiLine=False)
    else:
        text = spark.createDataFrame(list(_rows(source, len(names))), schema)
    return text.select(*[_cell(F.col(x), t).alias(x) for x, (_, t) in zip(names, fields)])


def _rows(source: IO[Any], width: int) -> Iterator[list[str]]:
    data = source.read()
    for row in csv.reader(io.StringIO(data.decode() if isinstance(data, bytes) else data, newline="")):
        if row:
            if len(row) != width:
                raise ValueError(f"CSV row has {len(row)} cells; the table has {width} columns")
            yield row


def from_dicts(spark: SparkSession, rows: Iterable[dict[str, Any]], fields: list[tuple[str, Type]]) -> DataFrame:
    """Missing keys are NULL."""
    schema = T.StructType([T.StructField(f"s{i}", to_spark(t)) for i, (_, t) in enumerate(fields)])
    return spark.createDataFrame([tuple(to_storage(row.get(name), t) for name, t in fields) for row in rows], schema)
