"""Functions by name: how each computes its type and builds its Spark column. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.types import BOOLEAN, DATE, DATETIME, FLOAT, INTEGER, NULL, STRING, TIMESTAMP, Array, Scalar, Struct, Type, merge_or_integer, to_spark


@dataclass(frozen=True)
class Value:
    """A bound expression."""

    col: Column
    type: Type


def cast(value: Value, to: Type) -> Column:
    """``value`` as ``to``, which it merges into: widening only."""
    return value.col if value.type == to else value.col.cast(to_spark(to))


Builder = Callable[[list[Value]], Value]


def _arity(name: str, args: list[Value], least: int, most: int | None = None) -> None:
    if len(args) < least or (most is not None and len(args) > most):
        raise ValueError(f"{name} takes {least if most == least else f'{least} or more'} arguments, not {len(args)}")


def _numeric(name: str, *args: Value) -> None:
    for a in args:
        if a.type not in (INTEGER, FLOAT, NULL):
            raise ValueError(f"{name} takes numbers but was given type: {a.type}")


def _mod(args: list[Value]) -> Value:
    _arity("MOD", args, 2, 2)
    _numeric("MOD", *args)
    kind = merge_or_integer(*(a.type for a in args))
    return Value(cast(args[0], kind) % cast(args[1], kind), kind)


def _concat(args: list[Value]) -> Value:
    _arity("CONCAT", args, 1)
    for a in args:
        if a.type not in (STRING, NULL):
            raise ValueError(f"CONCAT takes strings but was given type: {a.type}")
    return Value(F.concat(*[a.col.cast("string") for a in args]), STRING)


def _timestamp(args: list[Value]) -> Value:
    _arity("TIMESTAMP", args, 1, 1)
    if args[0].type not in (STRING, DATE, DATETIME, TIMESTAMP, NULL):
        raise ValueError(f"TIMESTAMP takes a string, date or datetime but was given type: {args[0].type}")
    return Value(args[0].col.cast("timestamp"), TIMESTAMP)


def _current_timestamp(args: list[Value]) -> Value:
    _arity("CURRENT_TIMESTAMP", args, 0, 0)
    return Value(F.current_timestamp(), TIMESTAMP)


SCALAR: dict[str, Builder] = {"MOD": _mod, "CONCAT": _concat, "TIMESTAMP": _timestamp, "CURRENT_TIMESTAMP": _current_timestamp}


@dataclass(frozen=True)
class AggregateSpec:
    """The result's type for the argument's, and what builds the column."""

    kind: Callable[[Type], Type]
    build: Callable[[Column], Column]


def _same_number(name: str) -> Callable[[Type], Type]:
    def kind(t: Type) -> Type:
        if t not in (INTEGER, FLOAT, NULL):
            raise ValueError(f"{name} takes numbers but was given type: {t}")
        return INTEGER if t == NULL else t

    return kind


def _ordered(name: str) -> Callable[[Type], Type]:
    def kind(t: Type) -> Type:
        if isinstance(t, (Array, Struct)):
            raise ValueError(f"{name} takes scalars but was given type: {t}")
        return INTEGER if t == NULL else t

    return kind


AGGREGATE: dict[str, AggregateSpec] = {
    "SUM": AggregateSpec(_same_number("SUM"), F.sum),
    "MAX": AggregateSpec(_ordered("MAX"), F.max),
    "MIN": AggregateSpec(_ordered("MIN"), F.min),
}

#: Names that have argument forms of their own.
SPECIAL = ("COUNT", "ARRAY_AGG")
#: Functions of a window alone.
ANALYTIC = ("ROW_NUMBER",)

#: Date parts. DAYOFWEEK counts from 0 on Monday; WEEK is the ISO week.
PARTS: dict[str, Callable[[Column], Column]] = {
    "DAYOFWEEK": F.weekday,
    "DAY": F.dayofmonth,
    "DAYOFYEAR": F.dayofyear,
    "WEEK": F.weekofyear,
    "ISOWEEK": F.weekofyear,
    "MONTH": F.month,
    "QUARTER": F.quarter,
    "YEAR": F.year,
    "ISOYEAR": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
}

#: What may be cast to what, beside each type to itself and NULL to all.
CASTS: dict[Scalar, tuple[Scalar, ...]] = {
    INTEGER: (FLOAT, STRING, BOOLEAN),
    FLOAT: (INTEGER, STRING, BOOLEAN),
    BOOLEAN: (INTEGER, FLOAT, STRING),
    STRING: (INTEGER, FLOAT, BOOLEAN, DATE, DATETIME, TIMESTAMP),
    DATE: (STRING, DATETIME, TIMESTAMP),
    DATETIME: (STRING, DATE, TIMESTAMP),
    TIMESTAMP: (STRING, DATE, DATETIME),
}


def count(distinct: bool, value: Column | None) -> Column:
    if value is None:
        return F.count(F.lit(1))
    return F.count_distinct(value) if distinct else F.count(value)


def array_agg(value: Column, distinct: bool, ignore_nulls: bool) -> Column:
    """collect_list drops NULLs, so they travel in structs; array_distinct keeps the order of first appearance."""
    items = F.collect_list(value) if ignore_nulls else F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"])
    return F.array_distinct(items) if distinct else items
