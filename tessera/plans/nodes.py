"""The syntax tree. Nodes are frozen and compare by structure, so grouped expressions are recognised by equality."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from tessera.types import Type


class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    type: Type


@dataclass(frozen=True)
class Name(Node):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Attribute(Node):
    """A resolved column; the binder puts these in place of names."""

    id: str
    type: Type


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class IsNull(Node):
    operand: Node
    negated: bool


@dataclass(frozen=True)
class InList(Node):
    operand: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class Between(Node):
    operand: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class Exists(Node):
    query: Node


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    otherwise: Node


@dataclass(frozen=True)
class Case(Node):
    comparand: Node | None
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: Type


@dataclass(frozen=True)
class Extract(Node):
    part: str
    operand: Node


@dataclass(frozen=True)
class ArrayOf(Node):
    type: Type | None
    items: tuple[Node, ...]


@dataclass(frozen=True)
class StructOf(Node):
    type: Type | None
    items: tuple[Node, ...]
    names: tuple[str | None, ...]


@dataclass(frozen=True)
class Member(Node):
    operand: Node
    name: str


@dataclass(frozen=True)
class Element(Node):
    operand: Node
    index: Node
    base: int


@dataclass(frozen=True)
class Order(Node):
    key: Node
    descending: bool


@dataclass(frozen=True)
class Over(Node):
    partition: tuple[Node, ...]
    order: tuple[Order, ...]


@dataclass(frozen=True)
class Call(Node):
    """``star`` for COUNT(*); nulls is "", IGNORE or RESPECT."""

    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    star: bool = False
    nulls: str = ""
    order: tuple[Order, ...] = ()
    limit: int | None = None
    over: Over | None = None


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str | None


@dataclass(frozen=True)
class Star(Node):
    table: Node | None
    leave_out: tuple[str, ...]
    replace: tuple[Item, ...]


@dataclass(frozen=True)
class Table(Node):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Unnest(Node):
    array: Node


@dataclass(frozen=True)
class Derived(Node):
    query: Node


@dataclass(frozen=True)
class From(Node):
    source: Node
    alias: str | None


@dataclass(frozen=True)
class Join(Node):
    kind: str
    right: From
    on: Node | None = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select(Node):
    distinct: bool
    items: tuple[Node, ...]
    first: From | None
    joins: tuple[Join, ...]
    where: Node | None
    group: tuple[Node, ...]
    having: Node | None


@dataclass(frozen=True)
class SetOperation(Node):
    op: str
    all: bool
    left: Node
    right: Node


@dataclass(frozen=True)
class Query(Node):
    ctes: tuple[tuple[str, Node], ...]
    body: Node
    order: tuple[Order, ...]
    limit: int | None
    offset: int


@dataclass(frozen=True)
class CreateTable(Node):
    path: tuple[str, ...]
    replace: bool
    keep: bool
    columns: tuple[tuple[str, Type], ...] | None
    query: Node | None


@dataclass(frozen=True)
class CreateView(Node):
    path: tuple[str, ...]
    replace: bool
    keep: bool
    query: Node
