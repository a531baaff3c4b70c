"""Queries to DataFrames. The plan is declared; its physical form is left to Spark.

What the planner itself decides: which tables and columns are read at all, where a chain of expansions starts, when an edge's row already
holds a node's, and that nothing is joined for a node of which only the identity matters. Patterns are matched as homomorphisms:
the same edge may be matched twice, as no uniqueness is asked for. All tables keep repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import AnalyzeError, PlanError
from graphloom.functions.procedures import procedure
from graphloom.operators.graph import FROM, LABELS, TO, TYPE, PropertyGraph, quoted
from graphloom.plans.ast import (
    Binary, Call, CallProcedure, CallSubquery, Clause, Expr, Item, LabelTest, Literal, Match, Node, Param, Path, Prop, Query, Rel, Return, Shape, Subquery, Unary, Unwind, Var, With,
)
from graphloom.plans.expressions import Bound, Translator, conjuncts, has_aggregate, kind_of, walk

ALL = "*"
MOST_HOPS = 30


@dataclass
class Binding:
    """Rows and what their columns stand for; df is None for the one row without columns that a query starts with."""

    df: DataFrame | None = None
    scope: dict[str, Bound] = field(default_factory=dict)


def needs_of(clauses: list[Clause]) -> dict[str, set[str]]:
    """For each variable, the properties and further columns that the clauses read. WITH n AS m hands m's needs on to n."""
    needs: dict[str, set[str]] = {}
    same: list[tuple[str, str]] = []
    for x in walk(clauses):
        if isinstance(x, Prop) and isinstance(x.base, Var):
            needs.setdefault(x.base.name, set()).add(x.name)
        elif isinstance(x, Node | Rel):
            needs.setdefault(x.name, set()).update(x.props)
        elif isinstance(x, LabelTest):
            needs.setdefault(x.name, set()).update((LABELS, TYPE))
        elif isinstance(x, Call) and x.args and isinstance(x.args[0], Var):
            name = x.name.lower()
            extra = {"labels": {LABELS}, "type": {TYPE}, "edgetype": {TYPE}, "edgetypes": {TYPE}, "keys": {ALL}, "properties": {ALL}, "startnode": {FROM}, "endnode": {TO}}.get(name, set())
            needs.setdefault(x.args[0].name, set()).update(extra)
        elif isinstance(x, Item) and isinstance(x.value, Var):
            same.append((x.value.name, x.name))
    changed = True
    while changed:
        changed = False
        for a, b in same:
            new = needs.get(b, set()) - needs.get(a, set())
            if new:
                needs.setdefault(a, set()).update(new)
                changed = True
    return needs


class Planner:
    """One statement over one view of a graph."""

    def __init__(self, graph: PropertyGraph, params: dict[str, object] | None = None, context=None):
        self.graph, self.params, self.context = graph, params or {}, context
        self.numbers = count()
        self.needs: dict[str, set[str]] = {}
        self.later: list[Expr] = []

    # queries

    def query(self, q: Query) -> DataFrame:
        frames = [self.single(part) for part in q.parts]
        out = frames[0]
        for df, keep in zip(frames[1:], q.keep):
            if df.columns != out.columns:
                raise AnalyzeError("the parts of a union must have the same columns")
            out = out.union(df) if keep else out.union(df).distinct()
        return out

    def single(self, clauses: list[Clause]) -> DataFrame:
        binding = self.clauses(clauses, Binding())
        last = clauses[-1]
        if isinstance(last, CallProcedure) and len(clauses) == 1:
            return binding.df.select(*(quoted(b.column).alias(n) for n, b in binding.scope.items()))
        if not isinstance(last, Return):
            raise PlanError("a query must end with RETURN")
        return binding.df

    def clauses(self, clauses: list[Clause], binding: Binding) -> Binding:
        outer, self.needs = self.needs, needs_of(clauses)
        for name, extra in outer.items():
            self.needs.setdefault(name, set()).update(extra)
        try:
            for k, c in enumerate(clauses):
                binding = self.clause(c, binding, k == 0 and len(clauses) == 1)
        finally:
            self.needs = outer
        return binding

    def clause(self, c: Clause, b: Binding, alone: bool = False) -> Binding:
        if isinstance(c, Match):
            return self.optional(b, c) if c.optional else self.match(b, c)
        if isinstance(c, With):
            return self.project(b, c.shape, False)
        if isinstance(c, Return):
            return self.project(b, c.shape, True)
        if isinstance(c, Unwind):
            return self.unwind(b, c)
        if isinstance(c, CallProcedure):
            return self.call(b, c, alone)
        if isinstance(c, CallSubquery):
            return self.subquery(b, c)
        raise PlanError(f"{type(c).__name__.upper()} can't stand here")

    def rows(self, b: Binding) -> DataFrame:
        return b.df if b.df is not None else self.graph.spark.range(1).select(F.lit(0).alias("  unit"))

    # patterns

    def match(self, b: Binding, m: Match) -> Binding:
        patterns, where = self.labelled(m.patterns, m.where, b.scope)
        kinds: dict[str, str] = {}
        for path in patterns:
            for x in (*path.nodes, *path.rels):
                kind = "node" if isinstance(x, Node) else "edge"
                if kinds.setdefault(x.name, kind) != kind:
                    raise AnalyzeError(f"{x.name} is both a node and an edge")
        wanted = {p.base.name for e in conjuncts(where) if isinstance(e, Binary) and e.op == "=" for p, q in ((e.a, e.b), (e.b, e.a)) if isinstance(p, Prop) and isinstance(p.base, Var) and isinstance(q, Literal | Param)}
        for path in patterns:
            b = self.path(b, path, wanted)
        b = self.filter(b, where)
        return self.cut(b, m.order, m.skip, m.limit)

    def labelled(self, patterns: list[Path], where: Expr | None, scope: dict[str, Bound]) -> tuple[list[Path], Expr | None]:
        """Label and type tests that must hold become part of the patterns, where they choose the tables to read."""
        more: dict[str, list[str]] = {}
        rest: Expr | None = None
        nodes = {n.name for p in patterns for n in p.nodes if n.name not in scope}
        rels = {r.name for p in patterns for r in p.rels if not r.types and r.hops is None and r.name not in scope}
        for e in conjuncts(where):
            if isinstance(e, LabelTest) and (e.name in nodes or e.name in rels and len(e.labels) == 1 and e.name not in more):
                more.setdefault(e.name, []).extend(e.labels)
            else:
                rest = e if rest is None else Binary("AND", rest, e)
        if not more:
            return patterns, where
        return [Path([replace(n, labels=list(dict.fromkeys(n.labels + more.get(n.name, [])))) for n in p.nodes], [replace(r, types=r.types or more.get(r.name, [])) for r in p.rels], p.name) for p in patterns], rest

    def path(self, b: Binding, path: Path, wanted: set[str]) -> Binding:
        for n in path.nodes:
            self.graph.check_labels(n.labels)
        for r in path.rels:
            self.graph.check_types(r.types)
        bound = [k for k, n in enumerate(path.nodes) if n.name in b.scope]
        if bound:
            start, cur = bound[0], self.rebind(b, path.nodes[bound[0]])
        else:
            # the most restricted end of the chain is read first
            score = [2 * (bool(n.props) or n.name in wanted) + bool(n.labels) for n in path.nodes]
            start = score.index(max(score))
            cur = None
        steps = [(k, k + 1, path.rels[k]) for k in range(start, len(path.rels))] + [(k + 1, k, path.rels[k]) for k in range(start - 1, -1, -1)]
        if cur is None:
            cur = self.start(path, start, steps)
            if b.df is not None and not any(n.name in b.scope for n in path.nodes):
                merged = {**b.scope, **cur.scope}
                cur = Binding(b.df.crossJoin(cur.df), merged)
            elif b.df is None:
                cur.scope = {**b.scope, **cur.scope}
        came_along = steps and steps[0][2].name in cur.scope and steps[0][2].name not in b.scope
        for k, (near, far, rel) in enumerate(steps):
            if k == 0 and came_along:
                cur = self.finish(cur, path.nodes[far], None)
                continue
            cur = self.expand(cur, path.nodes[near].name, rel, path.nodes[far], forward=far > near)
        waiting, self.later = self.later, []
        for e in waiting:
            cur = self.filter(cur, e)
        if path.name:
            if path.name in cur.scope:
                raise AnalyzeError(f"{path.name} is bound already")
            nodes = F.array(*(quoted(cur.scope[n.name].column) for n in path.nodes))
            rels = [quoted(cur.scope[r.name].column) for r in path.rels]
            many = [c if r.hops else F.array(c) for c, r in zip(rels, path.rels)]
            value = F.struct(nodes.alias("nodes"), (F.concat(*many) if many else F.array().cast("array<bigint>")).alias("rels"))
            cur = Binding(cur.df.withColumn(path.name, value), {**cur.scope, path.name: Bound("path", path.name)})
        return cur

    def props(self, name: str) -> list[str]:
        wanted = self.needs.get(name, set())
        if ALL in wanted:
            return sorted(self.graph.properties)
        return sorted(p for p in wanted if not p.startswith(":"))

    def start(self, path: Path, first: int, steps: list) -> Binding:
        """The rows of the first node; with the first edge, if its rows hold the node's."""
        n = path.nodes[first]
        props, labels = self.props(n.name), LABELS in self.needs.get(n.name, set())
        if steps:
            near, far, rel = steps[0]
            direction = self.direction(rel, far > near)
            far_node = path.nodes[far]
            if rel.hops is None and not labels and far_node.name != n.name:
                tables = [(t, end) for t, end in self.graph.edge_tables(rel.types, direction, None, far_node.labels) if (t.src_labels if end == "src" else t.dst_labels) is None or set(n.labels) <= (t.src_labels if end == "src" else t.dst_labels)]
                sets = {t.src_labels if end == "src" else t.dst_labels for t, end in tables}
                holds = all(t.held == end and t.carrier is not None for t, end in tables)
                # an edge's ends exist, so a node of which only the identity matters isn't read at all
                if tables and (holds or not props) and (None not in sets or not n.labels):
                    df = self.graph.scan_edges(tables, rel.name, n.name, far_node.name, rel.types, self.props(rel.name), self.extra(rel.name), (n.name, props) if props else None)
                    ends = {t.dst_labels if end == "src" else t.src_labels for t, end in tables}
                    scope = {n.name: Bound("node", n.name, next(iter(sets)) if len(sets) == 1 else None), rel.name: Bound("edge", rel.name), far_node.name: Bound("node", far_node.name, next(iter(ends)) if len(ends) == 1 else None)}
                    b = self.constrain(Binding(df, scope), n.name, n.props)
                    return self.constrain(b, rel.name, rel.props)
        tables = self.graph.node_tables(n.labels)
        known = tables[0].labels if len(tables) == 1 else None
        b = Binding(self.graph.scan_nodes(n.labels, props, n.name, labels), {n.name: Bound("node", n.name, known)})
        return self.constrain(b, n.name, n.props)

    def direction(self, rel: Rel, forward: bool) -> str:
        return rel.direction if forward or rel.direction == "both" else {"out": "in", "in": "out"}[rel.direction]

    def extra(self, name: str) -> set[str]:
        wanted = self.needs.get(name, set())
        return {x for x in (TYPE, FROM, TO) if x in wanted}

    def finish(self, b: Binding, far: Node, given: set[str] | None) -> Binding:
        """Fetch what is wanted of a node whose identity is bound, unless its columns came along (given), and hold it against its pattern."""
        bound = b.scope[far.name]
        props, labels = self.props(far.name), LABELS in self.needs.get(far.name, set())
        checked = not far.labels or bound.labels is not None and set(far.labels) <= bound.labels
        if given is None and (props or labels or not checked):
            key = f"  n{next(self.numbers)}"
            read = set(far.labels) | (bound.labels or set())
            nodes = self.graph.scan_nodes(sorted(read), props, far.name, labels).withColumnRenamed(far.name, key)
            df = b.df.join(nodes, quoted(bound.column) == quoted(key)).drop(key)
            b = Binding(df, b.scope)
        return self.constrain(b, far.name, far.props)

    def expand(self, b: Binding, near: str, rel: Rel, far: Node, forward: bool) -> Binding:
        if rel.name in b.scope:
            raise AnalyzeError(f"the edge {rel.name.strip()} is bound already")
        if rel.hops is not None:
            return self.walk(b, near, rel, far, forward)
        here, known = b.scope[near], far.name in b.scope
        direction, n = self.direction(rel, forward), next(self.numbers)
        tables = self.graph.edge_tables(rel.types, direction, here.labels, far.labels)
        near_key, far_key = f"  a{n}", f"  b{n}" if known else far.name
        other = {"src": "dst", "dst": "src"}
        holds = not known and bool(tables) and LABELS not in self.needs.get(far.name, set()) and all(t.held == other[end] and t.carrier is not None for t, end in tables)
        edges = self.graph.scan_edges(tables, rel.name, near_key, far_key, rel.types, self.props(rel.name), self.extra(rel.name), (far.name, self.props(far.name)) if holds else None)
        condition = quoted(here.column) == quoted(near_key)
        if known:
            condition &= quoted(b.scope[far.name].column) == quoted(far_key)
        df = b.df.join(edges, condition).drop(near_key)
        scope = {**b.scope, rel.name: Bound("edge", rel.name)}
        if known:
            return self.constrain(self.rebind(Binding(df.drop(far_key), scope), far), rel.name, rel.props)
        sets = {t.dst_labels if end == "src" else t.src_labels for t, end in tables}
        scope[far.name] = Bound("node", far.name, next(iter(sets)) if len(sets) == 1 else None)
        out = self.constrain(Binding(df, scope), rel.name, rel.props)
        return self.finish(out, far, set() if holds else None)

    def walk(self, b: Binding, near: str, rel: Rel, far: Node, forward: bool) -> Binding:
        """Walks of a bounded number of edges: a union of chains, one for each length."""
        least, most = rel.hops
        if most is None:
            raise PlanError("a pattern of variable length needs an upper bound")
        if most > MOST_HOPS or least > most:
            raise PlanError(f"a pattern can have {MOST_HOPS} edges at most, and not fewer than its least")
        direction, n = self.direction(rel, forward), next(self.numbers)
        tables = self.graph.edge_tables(rel.types, direction)
        at, been = f"  at{n}", rel.name
        cur = b.df.withColumn(at, quoted(b.scope[near].column)).withColumn(been, F.array().cast("array<bigint>"))
        levels = [cur] if least == 0 else []
        for hop in range(1, most + 1):
            key, to, edge = f"  a{n}.{hop}", f"  b{n}.{hop}", f"  e{n}.{hop}"
            step = self.constrain(Binding(self.graph.scan_edges(tables, edge, key, to, rel.types, sorted(rel.props)), {edge: Bound("edge", edge)}), edge, rel.props).df.select(quoted(key), quoted(to), quoted(edge))
            order = F.concat(quoted(been), F.array(quoted(edge))) if forward else F.concat(F.array(quoted(edge)), quoted(been))
            cur = cur.join(step, quoted(at) == quoted(key)).withColumn(been, order).drop(at, key, edge).withColumnRenamed(to, at)
            if hop >= least:
                levels.append(cur)
        df = levels[0]
        for x in levels[1:]:
            df = df.unionByName(x)
        scope = {**b.scope, rel.name: Bound("list", rel.name)}
        if far.name in b.scope:
            return self.rebind(Binding(df.where(quoted(at) == quoted(b.scope[far.name].column)).drop(at), scope), far)
        scope[far.name] = Bound("node", far.name)
        return self.finish(Binding(df.withColumnRenamed(at, far.name), scope), far, None)

    def rebind(self, b: Binding, n: Node) -> Binding:
        """A pattern's node that is bound: its labels and properties still have to hold."""
        bound = b.scope[n.name]
        if bound.kind != "node":
            raise AnalyzeError(f"{n.name} isn't a node")
        if n.labels and not (bound.labels is not None and set(n.labels) <= bound.labels):
            key = f"  n{next(self.numbers)}"
            b = Binding(b.df.join(self.graph.scan_nodes(n.labels, (), key), quoted(bound.column) == quoted(key), "left_semi"), b.scope)
        return self.constrain(b, n.name, n.props)

    def constrain(self, b: Binding, name: str, props: dict[str, Expr]) -> Binding:
        if not props:
            return b
        t = Translator(self.graph, b.scope, self.params)
        df = b.df
        for k, v in props.items():
            if not {x.name for x in walk(v) if isinstance(x, Var)} <= set(b.scope):
                self.later.append(Binary("=", Prop(Var(name), k), v))  # it waits for the other rows
                continue
            df = df.where(t.boolean(Binary("=", Prop(Var(name), k), v)))
        return Binding(df, b.scope)

    # conditions and subqueries

    def filter(self, b: Binding, where: Expr | None) -> Binding:
        for e in conjuncts(where):
            if has_aggregate(e):
                raise AnalyzeError("an aggregate can't stand in WHERE")
            negated = isinstance(e, Unary) and e.op == "NOT" and isinstance(e.x, Subquery)
            sub = e.x if negated else e
            if isinstance(sub, Subquery) and sub.kind == "exists":
                df, condition, _ = self.aside(b, sub.patterns, sub.where)
                b = Binding(b.df.join(df, condition, "left_anti" if negated else "left_semi"), b.scope)
                continue
            b, resolved = self.resolve(b, e)
            condition = Translator(self.graph, b.scope, self.params, resolved).boolean(e)
            b = Binding(self.rows(b).where(condition), b.scope)
        return b

    def aside(self, b: Binding, patterns: list[Path], where: Expr | None) -> tuple[DataFrame, Column, dict[str, Bound]]:
        """Patterns matched for themselves: their rows under other names, the condition that ties them to b's, and their scope."""
        inner = Binding()
        mine, rest = [], []
        names = {x.name for p in patterns for x in (*p.nodes, *p.rels)}
        for e in conjuncts(where):
            used = {x.name for x in walk(e) if isinstance(x, Var)} | {x.name for x in walk(e) if isinstance(x, LabelTest)}
            (mine if used <= names else rest).append(e)
        inside = None
        for e in mine:
            inside = e if inside is None else Binary("AND", inside, e)
        inner = self.match(inner, Match(self.informed(patterns, b), inside))
        prefix = f"  s{next(self.numbers)}."
        df = inner.df.toDF(*(prefix + c for c in inner.df.columns))
        scope = {n: replace(x, column=prefix + x.column) for n, x in inner.scope.items()}
        condition = F.lit(True)
        for n, x in scope.items():
            if n in b.scope:
                condition &= quoted(b.scope[n].column) == quoted(x.column)
        both = Translator(self.graph, {**b.scope, **{n: x for n, x in scope.items() if n not in b.scope}}, self.params)
        for e in rest:
            condition &= both.boolean(e)
        return df, condition, scope

    def informed(self, patterns: list[Path], b: Binding) -> list[Path]:
        """Patterns with the labels that outer rows' nodes are known to have."""
        known = {n: sorted(x.labels) for n, x in b.scope.items() if x.kind == "node" and x.labels}
        return [replace(p, nodes=[replace(n, labels=list(dict.fromkeys(n.labels + known.get(n.name, [])))) for n in p.nodes]) for p in patterns]

    def resolve(self, b: Binding, e: Expr) -> tuple[Binding, dict[int, tuple[Column, str]]]:
        """Columns for the subqueries within an expression, joined on by the variables that they share with the rows."""
        resolved: dict[int, tuple[Column, str]] = {}
        for sub in [x for x in walk(e) if isinstance(x, Subquery)]:
            inner = self.match(Binding(), Match(self.informed(sub.patterns, b), sub.where))
            shared = [n for n in inner.scope if n in b.scope]
            prefix, value = f"  q{next(self.numbers)}.", "  value"
            keys = [quoted(inner.scope[n].column).alias(prefix + n) for n in shared]
            if sub.kind == "exists":
                df = inner.df.select(*keys, F.lit(True).alias(prefix + value)).distinct()
                result, kind = F.coalesce(quoted(prefix + value), F.lit(False)), "bool"
            elif sub.kind == "count":
                df = inner.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(prefix + value))
                result, kind = F.coalesce(quoted(prefix + value), F.lit(0)), "int"
            else:
                c = Translator(self.graph, inner.scope, self.params).column(sub.value)
                df = inner.df.select(*keys, c.alias(prefix + value)).groupBy(*(quoted(prefix + n) for n in shared)).agg(F.collect_list(quoted(prefix + value)).alias(prefix + value))
                result, kind = F.coalesce(quoted(prefix + value), F.array()), "list"
            condition = F.lit(True)
            for n in shared:
                condition &= quoted(b.scope[n].column) == quoted(prefix + n)
            left = self.rows(b)
            joined = left.join(df, condition, "left")
            b = Binding(joined, b.scope)
            resolved[id(sub)] = (result, kind)
        return b, resolved

    def optional(self, b: Binding, m: Match) -> Binding:
        df, condition, scope = self.aside(b, *self.labelled(m.patterns, m.where, b.scope))
        new = {n: x for n, x in scope.items() if n not in b.scope}
        joined = self.rows(b).join(df, condition, "left")
        keep = [quoted(c) for c in self.rows(b).columns]
        for n, x in new.items():
            keep += [quoted(c).alias(n + c[len(x.column) :]) for c in df.columns if c == x.column or c.startswith(x.column + ".")]
        out = Binding(joined.select(*keep), {**b.scope, **{n: replace(x, column=n) for n, x in new.items()}})
        return self.cut(out, m.order, m.skip, m.limit)

    # rows

    def unwind(self, b: Binding, u: Unwind) -> Binding:
        if u.name in b.scope:
            raise AnalyzeError(f"{u.name} is bound already")
        c, kind = Translator(self.graph, b.scope, self.params).typed(u.value)
        if kind not in ("list", "any", "null"):
            raise AnalyzeError("UNWIND needs a list")
        df = self.rows(b)
        df = df.limit(0).withColumn(u.name, F.lit(None)) if kind == "null" else df.withColumn(u.name, F.explode(c))
        return Binding(df, {**b.scope, u.name: Bound(kind_of(df.schema[u.name].dataType), u.name)})

    def call(self, b: Binding, c: CallProcedure, alone: bool) -> Binding:
        rows = procedure(c.name)(self.graph, self.context, *(self.value(a) for a in c.args))
        if c.yields is None and not alone:
            raise AnalyzeError("a CALL within a query needs YIELD")
        yields = c.yields or [(x, x) for x in rows.columns]
        for column, _ in yields:
            if column not in rows.columns:
                raise AnalyzeError(f"{c.name} has no column {column}")
        kinds = {f.name: kind_of(f.dataType) for f in rows.schema.fields}
        rows = rows.select(*(quoted(column).alias(name) for column, name in yields))
        scope = {name: Bound(kinds[column], name) for column, name in yields}
        if set(scope) & set(b.scope) or len(scope) < len(yields):
            raise AnalyzeError("a yielded name is bound already")
        out = Binding(rows if b.df is None else b.df.crossJoin(rows), {**b.scope, **scope})
        return self.filter(out, c.where)

    def subquery(self, b: Binding, c: CallSubquery) -> Binding:
        """A subquery of its own; its rows are combined with each row outside."""
        inner = self.query(c.query)
        if set(inner.columns) & set(b.scope):
            raise AnalyzeError("a returned name is bound already")
        scope = {f.name: Bound(kind_of(f.dataType), f.name) for f in inner.schema.fields}
        return Binding(inner if b.df is None else b.df.crossJoin(inner), {**b.scope, **scope})

    def value(self, e: Expr):
        if isinstance(e, Literal):
            return e.value
        if isinstance(e, Param):
            if e.name not in self.params:
                raise AnalyzeError(f"unknown parameter: ${e.name}")
            return self.params[e.name]
        raise AnalyzeError("a constant must stand here")

    def number(self, e: Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = self.value(e)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise AnalyzeError(f"{what} needs a whole number that isn't negative")
        return n

    def cut(self, b: Binding, order: list, skip: Expr | None, limit: Expr | None) -> Binding:
        if not order and skip is None and limit is None:
            return b
        t = Translator(self.graph, b.scope, self.params)
        df = self.rows(b)
        if order:
            df = df.orderBy(*(self.sorted(t.column(e), down) for e, down in order))
        return Binding(self.window(df, skip, limit), b.scope)

    def sorted(self, c: Column, down: bool) -> Column:
        """Null is greater than any value."""
        return c.desc_nulls_first() if down else c.asc_nulls_last()

    def window(self, df: DataFrame, skip: Expr | None, limit: Expr | None) -> DataFrame:
        n, m = self.number(skip, "SKIP"), self.number(limit, "LIMIT")
        if n:
            df = df.offset(n)
        return df if m is None else df.limit(m)

    def project(self, b: Binding, shape: Shape, final: bool) -> Binding:
        """RETURN, or WITH, whose nodes and edges keep their columns."""
        items = shape.items if shape.items is not None else [Item(Var(n), n) for n in b.scope if not n.startswith(" ")] + shape.extra
        if not items:
            raise AnalyzeError("there is nothing to return")
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise AnalyzeError("two returned columns have the same name")
        if not final and any(not i.aliased and not isinstance(i.value, Var) for i in items):
            raise AnalyzeError("an expression in WITH needs an alias")
        grouped = any(has_aggregate(i.value) for i in items)
        resolved: dict[int, tuple[Column, str]] = {}
        for e in [i.value for i in items] + [e for e, _ in shape.order]:
            b, more = self.resolve(b, e)
            resolved |= more
        t = Translator(self.graph, b.scope, self.params, resolved, aggregates=grouped)
        df = self.rows(b)
        keys: list[Column] = []
        values: list[Column] = []
        scope: dict[str, Bound] = {}
        for i in items:
            c, kind = t.typed(i.value)
            whole = isinstance(i.value, Var) and kind in ("node", "edge")
            scope[i.name] = Bound(kind, i.name, b.scope[i.value.name].labels if whole else None)
            if whole and not final:
                old = b.scope[i.value.name].column
                keys += [quoted(x).alias(i.name + x[len(old) :]) for x in df.columns if x == old or x.startswith(old + ".")]
            else:
                (values if has_aggregate(i.value) else keys).append(c.alias(i.name))
        own = {i.name: i.value for i in items}
        order: list[Column] = []
        hidden: list[Column] = []
        for k, (e, down) in enumerate(shape.order):
            e = self.substituted(e, own)
            at = next((i.name for i in items if i.value == e), None)
            if at is None:
                if shape.distinct:
                    raise AnalyzeError("rows that are distinct can only be ordered by what is returned")
                at = f"  o{k}"
                hidden.append(t.column(e).alias(at))
            order.append(self.sorted(quoted(at), down))
        out_names = [n for i in items for n in ([i.name] if final or scope[i.name].kind not in ("node", "edge") else [i.name + x[len(b.scope[i.value.name].column) :] for x in df.columns if x == b.scope[i.value.name].column or x.startswith(b.scope[i.value.name].column + ".")])]
        try:
            if grouped:
                aggregated = [h for h, (e, _) in zip(hidden, [(e, d) for e, d in shape.order if not any(i.value == self.substituted(e, own) for i in items)])]
                df = df.groupBy(*keys).agg(*values, *aggregated) if keys else df.agg(*values, *aggregated)
            else:
                df = df.select(*keys, *hidden)
            df = df.select(*(quoted(n) for n in out_names), *(quoted(f"  o{k}") for k in range(len(shape.order)) if f"  o{k}" in df.columns))
        except AnalysisException as e:
            raise AnalyzeError(str(e).splitlines()[0]) from e
        if shape.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        df = self.window(df, shape.skip, shape.limit)
        if hidden:
            df = df.select(*(quoted(n) for n in out_names))
        out = Binding(df, scope)
        return self.filter(out, shape.where)

    def substituted(self, e: Expr, own: dict[str, Expr]) -> Expr:
        """e with aliases replaced by what they stand for."""
        if isinstance(e, Var) and e.name in own:
            return own[e.name]
        if isinstance(e, Binary):
            return Binary(e.op, self.substituted(e.a, own), self.substituted(e.b, own))
        if isinstance(e, Unary):
            return Unary(e.op, self.substituted(e.x, own))
        if isinstance(e, Call):
            return replace(e, args=[self.substituted(a, own) for a in e.args])
        return e
