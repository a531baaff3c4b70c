"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Expr:
    """Any expression."""


@dataclass
class Literal(Expr):
    value: object


@dataclass
class Param(Expr):
    name: str


@dataclass
class Var(Expr):
    name: str


@dataclass
class Prop(Expr):
    base: Expr
    name: str


@dataclass
class Unary(Expr):
    op: str
    x: Expr


@dataclass
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass
class IsNull(Expr):
    x: Expr
    negated: bool


@dataclass
class LabelTest(Expr):
    name: str
    labels: list[str]


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class MapOf(Expr):
    items: dict[str, Expr]


@dataclass
class Index(Expr):
    x: Expr
    at: Expr


@dataclass
class Slice(Expr):
    x: Expr
    first: Expr | None
    last: Expr | None


@dataclass
class ListComprehension(Expr):
    name: str
    source: Expr
    where: Expr | None
    value: Expr | None


@dataclass
class Quantifier(Expr):
    kind: str
    name: str
    source: Expr
    where: Expr


@dataclass
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    default: Expr | None


@dataclass
class Subquery(Expr):
    """kind: exists, count or collect."""

    kind: str
    patterns: list[Path]
    where: Expr | None = None
    value: Expr | None = None


@dataclass
class Node:
    name: str
    labels: list[str]
    props: dict[str, Expr]
    named: bool = True


@dataclass
class Rel:
    """direction: out, in or both; hops: None for one edge, else (least, most)."""

    name: str
    types: list[str]
    props: dict[str, Expr]
    direction: str
    hops: tuple[int, int | None] | None = None
    named: bool = True


@dataclass
class Path:
    nodes: list[Node]
    rels: list[Rel]
    name: str | None = None


@dataclass
class Item:
    value: Expr
    name: str
    aliased: bool = False


@dataclass
class Shape:
    """What follows the items of RETURN or WITH."""

    items: list[Item] | None  # None: all
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # (expression, descending)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    extra: list[Item] = field(default_factory=list)  # items after a star


@dataclass
class Clause:
    """Any clause."""


@dataclass
class Match(Clause):
    patterns: list[Path]
    where: Expr | None = None
    optional: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass
class With(Clause):
    shape: Shape


@dataclass
class Return(Clause):
    shape: Shape


@dataclass
class Unwind(Clause):
    value: Expr
    name: str


@dataclass
class CallProcedure(Clause):
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]] | None
    where: Expr | None = None
    optional: bool = False


@dataclass
class CallSubquery(Clause):
    query: Query


@dataclass
class Create(Clause):
    patterns: list[Path]


@dataclass
class Merge(Clause):
    pattern: Path
    on_create: list[tuple] = field(default_factory=list)
    on_match: list[tuple] = field(default_factory=list)


@dataclass
class Delete(Clause):
    names: list[str]
    detach: bool


@dataclass
class SetItems(Clause):
    """Of (name, property, expression), (name, '+=', MapOf), (name, ':', labels)."""

    items: list[tuple]


@dataclass
class Remove(Clause):
    """Of (name, property) and (name, ':', labels)."""

    items: list[tuple]


@dataclass
class Query:
    """Parts and, between them, whether a union keeps repeated rows."""

    parts: list[list[Clause]]
    keep: list[bool]
    mode: str = ""  # explain or profile


@dataclass
class Command:
    """kind: create_graph, list_graph, load_graph, load_gml, load_neo4j, change_new, ... ; args by name."""

    kind: str
    args: dict[str, object] = field(default_factory=dict)
