"""Expressions to columns, with types checked on the way.

Kinds: int, float, str, bool, node, edge, list, map, path, null, and any where only the data can tell.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import AnalyzeError, PlanError
from graphloom.functions.aggregate import AGGREGATES, PERCENTILES
from graphloom.functions.scalar import SCALARS
from graphloom.operators.graph import FROM, LABELS, TO, TYPE, quoted
from graphloom.plans.ast import Binary, Call, Case, Expr, Index, IsNull, LabelTest, ListComprehension, ListOf, Literal, MapOf, Param, Prop, Quantifier, Slice, Subquery, Unary, Var

if TYPE_CHECKING:
    from graphloom.operators.graph import PropertyGraph

NUMBERS = {"int", "float", "any", "null"}


@dataclass(frozen=True)
class Bound:
    """A variable: its kind, column and, for a node, its one label set where that is known."""

    kind: str
    column: str
    labels: frozenset[str] | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.DecimalType):
        return "int" if t.scale == 0 else "float"
    if isinstance(t, T.FloatType | T.DoubleType):
        return "float"
    for cls, kind in ((T.StringType, "str"), (T.BooleanType, "bool"), (T.ArrayType, "list"), (T.MapType, "map"), (T.StructType, "map"), (T.NullType, "null")):
        if isinstance(t, cls):
            return kind
    return "any"


def walk(x):
    """Every syntax node in x."""
    if is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, list | tuple):
        for y in x:
            yield from walk(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from walk(y)


def is_aggregate(x: Expr) -> bool:
    return isinstance(x, Call) and (x.name.lower() in AGGREGATES or x.name.lower() in PERCENTILES)


def has_aggregate(x: Expr) -> bool:
    return any(is_aggregate(y) for y in walk(x))


def conjuncts(x: Expr | None) -> list[Expr]:
    if x is None:
        return []
    return [*conjuncts(x.a), *conjuncts(x.b)] if isinstance(x, Binary) and x.op == "AND" else [x]


class Translator:
    """Expressions over the variables of a scope. resolved: columns that stand for subqueries, by identity of their syntax."""

    def __init__(self, graph: PropertyGraph, scope: dict[str, Bound], params: dict[str, object], resolved: dict[int, tuple[Column, str]] | None = None, aggregates: bool = False):
        self.graph, self.scope, self.params, self.resolved, self.aggregates = graph, scope, params, resolved or {}, aggregates

    def column(self, e: Expr) -> Column:
        return self.typed(e)[0]

    def boolean(self, e: Expr) -> Column:
        c, kind = self.typed(e)
        if kind not in ("bool", "any", "null"):
            raise AnalyzeError("a condition must be boolean")
        return c.cast("boolean") if kind == "null" else c

    def typed(self, e: Expr) -> tuple[Column, str]:
        if id(e) in self.resolved:
            return self.resolved[id(e)]
        method = getattr(self, "_" + type(e).__name__.lower(), None)
        if method is None:
            raise PlanError(f"{type(e).__name__} has no plan here")
        return method(e)

    def constant(self, value) -> tuple[Column, str]:
        if value is None:
            return F.lit(None), "null"
        if isinstance(value, bool):
            return F.lit(value), "bool"
        if isinstance(value, int):
            return (F.lit(value).cast("long"), "int") if -(2**63) <= value < 2**63 else (F.lit(str(value)).cast("decimal(20,0)"), "int")
        if isinstance(value, float):
            return F.lit(value), "float"
        if isinstance(value, str):
            return F.lit(value), "str"
        if isinstance(value, list | tuple):
            return F.array(*(self.constant(v)[0] for v in value)), "list"
        if isinstance(value, dict):
            return F.struct(*(self.constant(v)[0].alias(k) for k, v in value.items())), "map"
        return F.lit(value), "any"

    def _literal(self, e: Literal):
        return self.constant(e.value)

    def _param(self, e: Param):
        if e.name not in self.params:
            raise AnalyzeError(f"unknown parameter: ${e.name}")
        return self.constant(self.params[e.name])

    def bound(self, name: str) -> Bound:
        if name not in self.scope:
            raise AnalyzeError(f"unknown variable: {name}")
        return self.scope[name]

    def _var(self, e: Var):
        b = self.bound(e.name)
        return (b.column if isinstance(b.column, Column) else quoted(b.column)), b.kind

    def _prop(self, e: Prop):
        if isinstance(e.base, Var):
            b = self.bound(e.base.name)
            if b.kind in ("node", "edge"):
                return quoted(f"{b.column}.{e.name}"), kind_of(self.graph.property_type(e.name))
        c, kind = self.typed(e.base)
        if kind not in ("map", "any"):
            raise AnalyzeError(f"a value of kind {kind} has no property {e.name}")
        return c.getField(e.name), "any"

    def _labeltest(self, e: LabelTest):
        b = self.bound(e.name)
        if b.kind == "edge":
            self.graph.check_types(e.labels)
            return quoted(f"{b.column}.{TYPE}").isin(e.labels), "bool"
        if b.kind != "node":
            raise AnalyzeError(f"{e.name} has no labels")
        self.graph.check_labels(e.labels)
        out = F.lit(True)
        for x in e.labels:
            out &= F.array_contains(quoted(f"{b.column}.{LABELS}"), x)
        return out, "bool"

    def _isnull(self, e: IsNull):
        c = self.column(e.x)
        return (c.isNotNull() if e.negated else c.isNull()), "bool"

    def _unary(self, e: Unary):
        c, kind = self.typed(e.x)
        if e.op == "NOT":
            if kind not in ("bool", "any", "null"):
                raise AnalyzeError("NOT needs a boolean")
            return ~c.cast("boolean"), "bool"
        if kind not in NUMBERS:
            raise AnalyzeError(f"the sign {e.op} needs a number")
        return (-c if e.op == "-" else c), kind

    def _binary(self, e: Binary):
        op = e.op
        if op in ("=", "<>") and any(isinstance(x, Literal) and x.value is None for x in (e.a, e.b)):
            other = e.b if isinstance(e.a, Literal) and e.a.value is None else e.a
            c = self.column(other)  # a comparison with NULL as written is a test for it
            return (c.isNull() if op == "=" else c.isNotNull()), "bool"
        (a, ka), (b, kb) = self.typed(e.a), self.typed(e.b)
        loose = {"any", "null"}
        if op in ("=", "<>"):
            if not (ka == kb or ka in loose or kb in loose or {ka, kb} <= NUMBERS):
                raise AnalyzeError(f"{ka} and {kb} can't be compared")
            return (a == b if op == "=" else a != b), "bool"
        if op in ("<", ">", "<=", ">="):
            if not ({ka, kb} <= NUMBERS or {ka, kb} <= {"str", *loose}):
                raise AnalyzeError(f"{ka} and {kb} have no order")
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op], "bool"
        if op in ("AND", "OR", "XOR"):
            if not {ka, kb} <= {"bool", *loose}:
                raise AnalyzeError(f"{op} needs booleans")
            a, b = a.cast("boolean"), b.cast("boolean")
            return (a & b if op == "AND" else a | b if op == "OR" else a != b), "bool"
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            if not {ka, kb} <= {"str", *loose}:
                raise AnalyzeError(f"{op} needs strings")
            return {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains, "=~": lambda x, y: F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$")))}[op](a, b), "bool"
        if op == "IN":
            if kb not in ("list", *loose):
                raise AnalyzeError("IN needs a list")
            items = e.b.items if isinstance(e.b, ListOf) else None
            if items is not None and all(isinstance(i, Literal) for i in items):
                return (a.isin([i.value for i in items]) if items else F.lit(False)), "bool"
            return F.array_contains(b, a), "bool"
        if op == "+" and "list" in (ka, kb):
            return F.concat(a if ka == "list" else F.array(a), b if kb == "list" else F.array(b)), "list"
        if op == "+" and "str" in (ka, kb):
            return F.concat(a.cast("string"), b.cast("string")), "str"
        if not {ka, kb} <= NUMBERS:
            raise AnalyzeError(f"{op} needs numbers, not {ka} and {kb}")
        whole = ka == kb == "int"
        if op == "^":
            return F.pow(a, b), "float"
        if op == "/" and whole:
            return F.call_function("div", a, b), "int"
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op], "int" if whole else "any" if "any" in (ka, kb) else "float"

    def _listof(self, e: ListOf):
        return F.array(*(self.column(i) for i in e.items)), "list"

    def _mapof(self, e: MapOf):
        return F.struct(*(self.column(v).alias(k) for k, v in e.items.items())), "map"

    def _index(self, e: Index):
        (x, kind), at = self.typed(e.x), self.column(e.at)
        if kind == "map":
            if not (isinstance(e.at, Literal) and isinstance(e.at.value, str)):
                raise PlanError("a map's key must be a string constant")
            return x.getField(e.at.value), "any"
        at = at.cast("int")
        return F.get(x, F.when(at < 0, F.size(x) + at).otherwise(at)), "any"

    def _slice(self, e: Slice):
        x = self.column(e.x)
        n = F.size(x)

        def place(v: Expr | None, default: Column) -> Column:
            if v is None:
                return default
            c = self.column(v).cast("int")
            return F.greatest(F.lit(0), F.least(n, F.when(c < 0, n + c).otherwise(c)))

        first, last = place(e.first, F.lit(0)), place(e.last, n)
        return F.slice(x, first + 1, F.greatest(last - first, F.lit(0))), "list"

    def _inner(self, name: str, c: Column) -> Translator:
        inner = dict(self.scope)
        inner[name] = Bound("any", c)  # type: ignore[arg-type]
        return Translator(self.graph, inner, self.params, self.resolved, self.aggregates)

    def _listcomprehension(self, e: ListComprehension):
        x = self.column(e.source)
        if e.where is not None:
            x = F.filter(x, lambda c: self._inner(e.name, c).boolean(e.where))
        if e.value is not None:
            x = F.transform(x, lambda c: self._inner(e.name, c).column(e.value))
        return x, "list"

    def _quantifier(self, e: Quantifier):
        x = self.column(e.source)
        test = lambda c: self._inner(e.name, c).boolean(e.where)
        if e.kind == "ALL":
            return F.forall(x, test), "bool"
        if e.kind == "ANY":
            return F.exists(x, test), "bool"
        if e.kind == "NONE":
            return ~F.exists(x, test), "bool"
        return F.size(F.filter(x, test)) == 1, "bool"

    def _case(self, e: Case):
        out, kind = None, "null"
        for test, value in e.whens:
            condition = self.boolean(test) if e.subject is None else self.boolean(Binary("=", e.subject, test))
            c, k = self.typed(value)
            out = F.when(condition, c) if out is None else out.when(condition, c)
            kind = k if kind == "null" else kind
        if e.default is not None:
            c, k = self.typed(e.default)
            out, kind = out.otherwise(c), k if kind == "null" else kind
        return out, kind

    def _subquery(self, e: Subquery):
        raise PlanError("a subquery can't stand here")

    def _call(self, e: Call):
        name = e.name.lower()
        if name in AGGREGATES or name in PERCENTILES:
            return self._aggregate(e, name)
        if name in ("labels", "keys", "type", "edgetype", "edgetypes", "id", "elementid", "startnode", "endnode", "properties", "nodes", "relationships", "length", "size"):
            return self._of_graph(e, name)
        if name not in SCALARS:
            raise AnalyzeError(f"unknown function: {e.name}")
        least, most, function, kind = SCALARS[name]
        if not least <= len(e.args) <= most:
            raise AnalyzeError(f"{e.name} doesn't take {len(e.args)} arguments")
        typed = [self.typed(a) for a in e.args]
        return function(*(c for c, _ in typed)), next((k for _, k in typed if k != "null"), "null") if kind == "same" else kind

    def _of_graph(self, e: Call, name: str):
        if len(e.args) != 1:
            raise AnalyzeError(f"{e.name} takes one argument")
        c, kind = self.typed(e.args[0])
        own = e.args[0].name if isinstance(e.args[0], Var) else None
        column = self.bound(own).column if own else ""

        def need(*kinds: str) -> None:
            if kind not in kinds:
                raise AnalyzeError(f"{e.name} doesn't take a value of kind {kind}")

        if name == "labels":
            need("node")
            return quoted(f"{column}.{LABELS}"), "list"
        if name in ("type", "edgetype", "edgetypes"):
            need("edge")
            return quoted(f"{column}.{TYPE}"), "str"
        if name in ("id", "elementid"):
            need("node", "edge")
            return c, "int"
        if name in ("startnode", "endnode"):
            need("edge")
            return quoted(f"{column}.{FROM if name == 'startnode' else TO}"), "int"
        if name in ("keys", "properties"):
            need("node", "edge")
            props = sorted(self.graph.properties)
            if name == "properties":
                return F.when(c.isNotNull(), F.struct(*(quoted(f"{column}.{p}").alias(p) for p in props))), "map"
            return F.when(c.isNotNull(), F.array_compact(F.array(*(F.when(quoted(f"{column}.{p}").isNotNull(), F.lit(p)) for p in props)))), "list"
        if name == "nodes":
            need("path")
            return c["nodes"], "list"
        if name == "relationships":
            need("path")
            return c["rels"], "list"
        if kind == "path":
            return F.size(c["rels"]).cast("long"), "int"
        need("str", "list", "any", "null")
        return (F.size(c) if kind == "list" else F.length(c) if kind == "str" else F.length(c.cast("string"))).cast("long"), "int"

    def _aggregate(self, e: Call, name: str):
        if not self.aggregates:
            raise AnalyzeError(f"the aggregate {e.name} can't stand here")
        if any(has_aggregate(a) for a in e.args):
            raise AnalyzeError("an aggregate can't hold another")
        if e.star:
            if name != "count":
                raise AnalyzeError(f"{e.name}(*) is unknown")
            return F.count(F.lit(1)), "int"
        if name in PERCENTILES:
            if len(e.args) != 2 or not isinstance(e.args[1], Literal):
                raise AnalyzeError(f"{e.name} takes a value and a constant")
            return PERCENTILES[name](self.column(e.args[0]), float(e.args[1].value)), "float"
        if len(e.args) != 1:
            raise AnalyzeError(f"{e.name} takes one argument")
        c, kind = self.typed(e.args[0])
        if name in ("avg", "sum", "stdev", "stdevp") and kind not in NUMBERS:
            raise AnalyzeError(f"{e.name} needs numbers")
        if name in ("min", "max") and kind in ("node", "edge", "path"):
            raise AnalyzeError(f"{e.name} doesn't take a value of kind {kind}")
        function, result = AGGREGATES[name]
        return function(c, e.distinct), kind if result == "same" else result
