"""Binds queries to lazy DataFrames. Catalyst does the rest: pushdown, pruning, join strategies and re-planning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.registry import Value, cast
from tessera.operators.expressions import GroupBinder, RowBinder, children, has_aggregate, refuse_windows
from tessera.plans import nodes as n
from tessera.plans.scope import Attr, Bound, Relation, Resolver, Scope, fresh
from tessera.types import INTEGER, Array, Struct, merge_or_integer, settled, to_spark

if TYPE_CHECKING:
    from tessera.sources.catalog import Catalog

JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}


class Planner:
    def __init__(self, spark: SparkSession, catalog: Catalog) -> None:
        self.spark, self.catalog = spark, catalog
        self.unnamed = 0
        #: Views that are being read, outermost first.
        self.open_views: list[tuple[str, ...]] = []

    # Queries

    def query(self, node: n.Node, ctes: dict[str, Bound] | None = None, outer: Resolver | None = None) -> Bound:
        ctes = ctes or {}
        if isinstance(node, n.Select):
            return self.select(node, ctes, outer)
        if isinstance(node, n.SetOperation):
            return self.set_operation(node, ctes, outer)
        assert isinstance(node, n.Query)
        names = [name for name, _ in node.ctes]
        if len(set(names)) < len(names):
            raise ValueError(f"Duplicate names in WITH clauses are not allowed: {names}")
        for name, query in node.ctes:
            ctes = ctes | {name: self.query(query, ctes, outer)}
        out = self.query(node.body, ctes, outer)
        if node.order:
            out = Bound(out.df.orderBy(*[self.order_key(o, out) for o in node.order]), out.attrs)
        if node.limit is not None:
            out = Bound((out.df.offset(node.offset) if node.offset else out.df).limit(node.limit), out.attrs)
        return out

    def order_key(self, order: n.Order, out: Bound) -> Column:
        attr = self.output(order.key, out)
        col = F.col(attr.id)
        return col.desc_nulls_last() if order.descending else col.asc_nulls_last()

    def output(self, key: n.Node, out: Bound) -> Attr:
        """The output column that an ORDER BY key names, by name or by position from 1."""
        if isinstance(key, n.Literal):
            if key.type != INTEGER:
                raise ValueError(f"Attempt to order by a literal non-integer constant {key.value}")
            if not 1 <= key.value <= len(out.attrs):
                raise ValueError(f"ORDER BY {key.value} is not one of {len(out.attrs)} columns")
            return out.attrs[key.value - 1]
        if isinstance(key, n.Name):
            return Scope([Relation("", out.attrs)]).find(key.path)[0]
        raise ValueError(f"Invalid field specification {key}")

    def set_operation(self, node: n.SetOperation, ctes: dict[str, Bound], outer: Resolver | None) -> Bound:
        left, right = self.query(node.left, ctes, outer), self.query(node.right, ctes, outer)
        if len(left.attrs) != len(right.attrs):
            raise ValueError(f"Queries in {node.op} {'ALL' if node.all else 'DISTINCT'} have mismatched column count: {len(left.attrs)} vs {len(right.attrs)}")
        if node.all and node.op != "UNION":
            raise NotImplementedError(f"set operation {node.op} ALL not implemented")
        attrs = [Attr(a.name, merge_or_integer(a.type, b.type), fresh()) for a, b in zip(left.attrs, right.attrs)]
        a, b = (side.df.select(*[cast(Value(F.col(x.id), x.type), y.type).alias(y.id) for x, y in zip(side.attrs, attrs)]) for side in (left, right))
        if node.op == "UNION":
            return Bound(a.union(b) if node.all else a.union(b).distinct(), attrs)
        return Bound(a.intersect(b) if node.op == "INTERSECT" else a.subtract(b), attrs)

    def select(self, node: n.Select, ctes: dict[str, Bound], outer: Resolver | None) -> Bound:
        if node.first is None:
            df, scope = self.spark.range(1).select(), Scope([], outer)
        else:
            df, scope = self.from_(node.first, node.joins, ctes, outer)
        rows = RowBinder(self, scope, ctes)
        if node.where is not None:
            if has_aggregate(node.where):
                raise ValueError("Invalid WHERE expression: aggregates are not allowed")
            refuse_windows(node.where, "WHERE")
            df = df.where(rows.boolean(node.where, "WHERE expression"))
        items = self.items(node.items, rows)
        grouped = bool(node.group) or any(has_aggregate(v) for v, _ in items) or (node.having is not None and has_aggregate(node.having))
        binder: RowBinder = rows
        if grouped:
            binder = GroupBinder(rows, self.keys(node, items, rows))
        values = [binder.bind(v) for v, _ in items]
        having = None
        if node.having is not None:
            if not isinstance(binder, GroupBinder):
                binder = GroupBinder(rows, [(n.Attribute(a.id, a.type), a) for r in scope.relations for a in r.attrs])
            binder.aliases = {name: v for v, name in items}
            refuse_windows(node.having, "HAVING", binder.aliases)
            having = binder.boolean(node.having, "HAVING expression")
        if grouped:
            assert isinstance(binder, GroupBinder)
            keys = list({key.id: rows.bind(expr).col.alias(key.id) for expr, key in binder.keys.items()}.values())
            aggregates = [col.alias(attr.id) for attr, col in binder.aggregates.values()]
            if keys and not aggregates:
                df = df.select(*keys).distinct()
            else:
                df = df.groupBy(*keys).agg(*(aggregates or [F.count(F.lit(1)).alias(fresh())]))
        if having is not None:
            df = df.where(having)
        binders = [binder] if grouped or binder is rows else [rows, binder]
        totals, arrays = ([x for b in binders for x in of(b)] for of in (lambda b: b.totals, lambda b: b.arrays))
        whole = df
        if totals:
            df = df.crossJoin(F.broadcast(whole.agg(*[col.alias(i) for i, col in totals])))  # one row of scalars
        if arrays:  # one row too, but as large as all rows: Spark's own size check decides how it travels
            df = df.crossJoin(whole.agg(*[col.alias(i) for i, col in arrays]))
        attrs = [Attr(name, settled(v.type), fresh()) for v, (_, name) in zip(values, items)]
        df = df.select(*[cast(v, a.type).alias(a.id) for v, a in zip(values, attrs)])
        return Bound(df.distinct() if node.distinct else df, attrs)

    def items(self, nodes: tuple[n.Node, ...], rows: RowBinder) -> list[tuple[n.Node, str]]:
        """(expression, output name) for each column, stars expanded."""
        out: list[tuple[n.Node, str | None]] = []
        for node in nodes:
            if isinstance(node, n.Star):
                out += self.star(node, rows.scope)
            else:
                assert isinstance(node, n.Item)
                out.append((node.value, node.alias or (node.value.path[-1] if isinstance(node.value, n.Name) else node.value.name if isinstance(node.value, n.Member) else None)))
        return [(v, name or f"_f{i}") for i, (v, name) in enumerate(out, 1)]

    def star(self, node: n.Star, scope: Scope) -> list[tuple[n.Node, str | None]]:
        relations = scope.relations
        if node.table is not None:
            if not isinstance(node.table, n.Name) or len(node.table.path) != 1:
                raise ValueError(f"Cannot select {node.table}.*")
            relations = [r for r in relations if r.alias == node.table.path[0]]
            if not relations:
                raise ValueError(f"Cannot select {node.table.path[0]}.*: no such table")
        replaced = {item.alias: item.value for item in node.replace}
        return [(replaced.get(a.name, n.Attribute(a.id, a.type)), a.name) for r in relations for a in r.attrs if a.name not in node.leave_out]

    def keys(self, node: n.Select, items: list[tuple[n.Node, str]], rows: RowBinder) -> list[tuple[n.Node, Attr]]:
        """(canonical expression, group key) for each GROUP BY element: a column, a select alias or a position."""
        out = []
        plain = GroupBinder(rows, [])
        for key in node.group:
            if isinstance(key, n.Literal):
                if key.type != INTEGER:
                    raise ValueError(f"Attempt to group by a literal non-integer constant {key.value}")
                if not 1 <= key.value <= len(node.items) or isinstance(node.items[key.value - 1], n.Star):
                    raise ValueError(f"cannot GROUP BY {key.value}th selector")
                before = sum(len(self.star(x, rows.scope)) if isinstance(x, n.Star) else 1 for x in node.items[: key.value - 1])
                key = items[before][0]
            elif isinstance(key, n.Name) and not rows.scope.find_all(key.path):
                named = [v for v, name in items if (name,) == key.path]
                if len(named) > 1:
                    raise ValueError(f"field {key.path[0]} is ambiguous: present in {named!r}")
                key = named[0] if named else key
            if has_aggregate(key):
                raise ValueError("GROUP BY expressions cannot contain aggregates")
            value = rows.bind(key)
            out.append((plain.canonical(key), Attr("", settled(value.type), fresh())))
        return out

    # FROM

    def from_(self, first: n.From, joins: tuple[n.Join, ...], ctes: dict[str, Bound], outer: Resolver | None) -> tuple[DataFrame, Scope]:
        bound, alias = self.source(first, ctes, outer)
        df, scope = bound.df, Scope([Relation(alias, bound.attrs)], outer)
        for join in joins:
            if join.kind not in JOINS:
                raise NotImplementedError(f"Join type {join.kind} is not supported")
            lateral = self.lateral(df, join, scope, ctes)
            if lateral is not None:
                df, scope = lateral
                continue
            bound, alias = self.source(join.right, ctes, outer)
            if any(r.alias == alias for r in scope.relations):
                raise ValueError(f"Duplicate table alias {alias} in the same FROM clause")
            left, right = scope, Relation(alias, bound.attrs)
            scope = Scope([*left.relations, right], outer)
            how = JOINS[join.kind]
            if join.on is not None:
                refuse_windows(join.on, "JOIN conditions")
                on = RowBinder(self, scope, ctes).boolean(join.on, "JOIN condition")
            elif join.using:
                on = self.using(join.using, left, right, scope, ctes)
            elif how == "cross":
                df = df.crossJoin(bound.df)
                continue
            else:
                on = self.natural(left, right, scope, ctes)
            df = df.join(bound.df, on, "inner" if how == "cross" else how)
        return df, scope

    def equal(self, pairs: list[tuple[Attr, Attr]], scope: Scope, ctes: dict[str, Bound]) -> Column:
        rows = RowBinder(self, scope, ctes)
        return reduce(lambda a, b: a & b, [rows.bind(n.Binary("=", n.Attribute(a.id, a.type), n.Attribute(b.id, b.type))).col for a, b in pairs])

    def using(self, names: tuple[str, ...], left: Scope, right: Relation, scope: Scope, ctes: dict[str, Bound]) -> Column:
        """Equality on each name, which one earlier table and the right one have; both columns stay."""
        pairs = []
        for name in names:
            found = [(r, a) for r in [*left.relations, right] for a in r.attrs if a.name == name]
            if len(found) != 2:
                raise ValueError(f"JOIN USING key must exist in exactly two tables; exists in these: {[r.alias for r, _ in found]!r}")
            if found[1][0] is not right:
                raise ValueError(f"JOIN USING key must exist in joined table, exists only in these: {[(r.alias, name) for r, _ in found]!r}")
            pairs.append((found[0][1], found[1][1]))
        return self.equal(pairs, scope, ctes)

    def natural(self, left: Scope, right: Relation, scope: Scope, ctes: dict[str, Bound]) -> Column:
        """A join without a condition is on all the names that both sides have."""
        pairs = []
        for a in right.attrs:
            same = [x for r in left.relations for x in r.attrs if x.name == a.name]
            if len(same) > 1:
                raise ValueError(f"field {a.name} is ambiguous: present in {[r.alias for r in left.relations for x in r.attrs if x.name == a.name]!r}")
            pairs += [(x, a) for x in same]
        if not pairs:
            raise ValueError(f"JOIN with {right.alias} has no condition and no common columns")
        return self.equal(pairs, scope, ctes)

    def source(self, item: n.From, ctes: dict[str, Bound], outer: Resolver | None) -> tuple[Bound, str]:
        """A FROM item under fresh column ids, and the name it goes by."""
        source = item.source
        if isinstance(source, n.Table):
            cte = ctes.get(".".join(source.path))
            if cte is not None:
                return cte.renewed(), item.alias or ".".join(source.path)
            return self.catalog.scan(source.path, self), item.alias or source.path[-1]
        self.unnamed += 1
        alias = item.alias or f"__join{self.unnamed}"
        if isinstance(source, n.Derived):
            return self.query(source.query, ctes, outer).renewed(), alias
        assert isinstance(source, n.Unnest)
        return self.unnest(source, ctes), alias

    def lateral(self, df: DataFrame, join: n.Join, scope: Scope, ctes: dict[str, Bound]) -> tuple[DataFrame, Scope] | None:
        """A join with UNNEST of an array that the row itself holds: its elements beside the row. None for any other join."""
        source = join.right.source
        if not isinstance(source, n.Unnest) or not (names := names_in(source.array)) or not any(scope.find_all(x.path) for x in names):
            return None
        if join.kind not in ("CROSS", "INNER", "LEFT") or join.using or (join.kind == "LEFT" and join.on is not None):
            raise NotImplementedError("UNNEST of a column is a comma, CROSS or INNER join, or a LEFT join without a condition")
        value = RowBinder(self, scope, ctes).bind(source.array)
        self.unnamed += 1
        alias = join.right.alias or f"__join{self.unnamed}"
        if any(r.alias == alias for r in scope.relations):
            raise ValueError(f"Duplicate table alias {alias} in the same FROM clause")
        rows = F.explode_outer if join.kind == "LEFT" else F.explode
        attrs, fields = self.elements(value)
        item = fresh()
        df = df.select("*", rows(value.col).alias(item)).select("*", *[f(F.col(item)).alias(a.id) for f, a in zip(fields, attrs)]).drop(item)
        if alias == join.right.alias and len(attrs) == 1 and attrs[0].name == "f0_":
            attrs = [Attr(alias, attrs[0].type, attrs[0].id)]  # an element goes by the alias itself
        scope = Scope([*scope.relations, Relation(alias, attrs)], scope.outer)
        if join.on is not None:
            df = df.where(RowBinder(self, scope, ctes).boolean(join.on, "JOIN condition"))
        return df, scope

    def unnest(self, node: n.Unnest, ctes: dict[str, Bound]) -> Bound:
        value = RowBinder(self, Scope(), ctes).bind(node.array)
        attrs, fields = self.elements(value)
        df = self.spark.tvf.explode(value.col).toDF("x")
        return Bound(df.select(*[f(F.col("x")).alias(a.id) for f, a in zip(fields, attrs)]), attrs)

    def elements(self, value: Value) -> tuple[list[Attr], list[Callable[[Column], Column]]]:
        """The columns that an array's elements make, and how each comes from an element."""
        if not isinstance(value.type, Array):
            raise ValueError(f"UNNESTing a non-array-typed value: {value.type}")
        element = value.type.element
        if not isinstance(element, Struct):
            return [Attr("f0_", element, fresh())], [lambda x: x]
        attrs, unnamed = [], 0
        for name, kind in zip(element.names, element.types):
            attrs.append(Attr(name or f"f{unnamed}_", kind, fresh()))
            unnamed += name is None
        return attrs, [lambda x, i=i: x.getField(f"_{i}") for i in range(1, len(attrs) + 1)]


def names_in(node: n.Node) -> list[n.Name]:
    return [node] if isinstance(node, n.Name) else [x for c in children(node) for x in names_in(c)]


def typed_scan(df: DataFrame, fields: list[tuple[str, object]]) -> Bound:
    """A stored table's columns under fresh ids, integers and floats widened."""
    attrs = [Attr(name, kind, fresh()) for name, kind in fields]  # type: ignore[arg-type]
    plain = df.toDF(*[f"s{i}" for i in range(len(attrs))]) if len(set(df.columns)) < len(df.columns) or any("`" in c for c in df.columns) else df
    return Bound(plain.select(*[F.col(f"`{c}`").cast(to_spark(a.type)).alias(a.id) for c, a in zip(plain.columns, attrs)]), attrs)
