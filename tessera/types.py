"""The dialect's types, how they map to Spark's, and which of them merge without a cast."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T


class Type:
    """A scalar, array or struct type; values compare and hash by structure."""


@dataclass(frozen=True)
class Scalar(Type):
    name: str

    def __repr__(self) -> str:
        return self.name


BOOLEAN, DATE, DATETIME, INTEGER, FLOAT, STRING, TIMESTAMP = map(Scalar, ("BOOLEAN", "DATE", "DATETIME", "INTEGER", "FLOAT", "STRING", "TIMESTAMP"))
#: Of NULL literals, until something gives them a type.
NULL = Scalar("NULL")


@dataclass(frozen=True)
class Array(Type):
    element: Type

    def __post_init__(self) -> None:
        if isinstance(self.element, Array):
            raise ValueError("Cannot create arrays of arrays!")

    def __repr__(self) -> str:
        return f"ARRAY<{self.element!r}>"


@dataclass(frozen=True)
class Struct(Type):
    """Fields may lack names; in Spark they are always named by position, so names never stand in a cast's way."""

    names: tuple[str | None, ...]
    types: tuple[Type, ...]

    def __post_init__(self) -> None:
        if len(self.names) != len(self.types):
            raise ValueError(f"length of fields and types don't match: {len(self.names)}!={len(self.types)}")

    def __repr__(self) -> str:
        return "STRUCT<" + ", ".join(f"{n} {t!r}" if n else repr(t) for n, t in zip(self.names, self.types)) + ">"


#: Type names and their aliases.
SCALARS = {t.name: t for t in (BOOLEAN, DATE, DATETIME, INTEGER, FLOAT, STRING, TIMESTAMP)} | {"BOOL": BOOLEAN, "INT64": INTEGER, "FLOAT64": FLOAT}

_SPARK = {BOOLEAN: T.BooleanType(), DATE: T.DateType(), DATETIME: T.TimestampNTZType(), INTEGER: T.LongType(), FLOAT: T.DoubleType(), STRING: T.StringType(), TIMESTAMP: T.TimestampType(), NULL: T.NullType()}


def scalar(name: str) -> Scalar:
    try:
        return SCALARS[name.upper()]
    except KeyError:
        raise ValueError(f"{name!r} is not a valid type") from None


def to_spark(t: Type) -> T.DataType:
    if isinstance(t, Array):
        return T.ArrayType(to_spark(t.element))
    if isinstance(t, Struct):
        return T.StructType([T.StructField(f"_{i + 1}", to_spark(x)) for i, x in enumerate(t.types)])
    return _SPARK[t]


def from_spark(t: T.DataType) -> Type:
    """Integers widen to INTEGER and floats to FLOAT; what the dialect lacks is a ValueError.

    Decimals are such: as FLOAT they would lose digits, so whoever registers them must cast them.
    """
    if isinstance(t, T.ArrayType):
        return Array(from_spark(t.elementType))
    if isinstance(t, T.StructType):
        return Struct(tuple(f.name for f in t.fields), tuple(from_spark(f.dataType) for f in t.fields))
    if isinstance(t, T.IntegralType):
        return INTEGER
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(t, (T.CharType, T.VarcharType)):
        return STRING
    for ours, theirs in _SPARK.items():
        if isinstance(t, type(theirs)):
            return ours
    raise ValueError(f"Columns of type {t.simpleString()} are not supported")


def _merged_name(names: set[str | None]) -> str | None:
    named = names - {None}
    if len(named) > 1:
        raise ValueError(f"Cannot merge Structs; field names {sorted(named)} do not match")
    return named.pop() if named else None


def merge(*types: Type) -> Type:
    """The type that values of all of these take on together."""
    kinds = list(dict.fromkeys(t for t in types if t != NULL))
    if not kinds:
        raise ValueError("No types provided to merge")
    if len(kinds) == 1:
        return kinds[0]
    for weak, strong in ((INTEGER, FLOAT), (STRING, DATE), (STRING, TIMESTAMP)):
        if set(kinds) == {weak, strong}:
            return strong
    if all(isinstance(t, Struct) for t in kinds):
        if len({len(t.types) for t in kinds}) > 1:
            raise ValueError(f"Cannot merge types {kinds}; number of fields varies!")
        columns = list(zip(*(t.types for t in kinds)))
        return Struct(tuple(_merged_name(set(n)) for n in zip(*(t.names for t in kinds))), tuple(merge(*c) for c in columns))
    raise ValueError(f"Cannot implicitly coerce the given types: {tuple(types)!r}")


def merge_or_integer(*types: Type) -> Type:
    """Like :func:`merge`, where NULLs alone count as INTEGER."""
    return INTEGER if all(t == NULL for t in types) else merge(*types)


def settled(t: Type) -> Type:
    """``t`` with INTEGER for whatever is only known to be NULL."""
    if isinstance(t, Array):
        return Array(settled(t.element))
    if isinstance(t, Struct):
        return Struct(t.names, tuple(map(settled, t.types)))
    return INTEGER if t == NULL else t


def to_python(value: Any, t: Type) -> Any:
    """A collected value as the client hands it out: tuples for arrays and structs, naive UTC timestamps."""
    if value is None:
        return None
    if isinstance(t, Array):
        return tuple(to_python(x, t.element) for x in value)
    if isinstance(t, Struct):
        return tuple(to_python(x, u) for x, u in zip(tuple(value), t.types))
    return value


def to_storage(value: Any, t: Type) -> Any:
    """A client's value as Spark takes it for a column of type ``t``."""
    if value is None:
        return None
    if isinstance(t, Array):
        return [to_storage(x, t.element) for x in value]
    if isinstance(t, Struct):
        return Row(*[to_storage(x, u) for x, u in zip(value, t.types)])
    if t == FLOAT:
        return float(value)
    if t == INTEGER:
        return int(value)
    if t == DATE and isinstance(value, str):
        return datetime.date.fromisoformat(value)
    if t in (DATETIME, TIMESTAMP) and isinstance(value, str):
        return datetime.datetime.fromisoformat(value)
    return value
