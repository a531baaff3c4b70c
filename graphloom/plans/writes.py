"""CREATE, MERGE, SET, REMOVE and DELETE, into an open change.

Rows that a statement matched are written once with a row number, so that the ids made from it stay the same whenever they
are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import AnalyzeError, ExecError, PlanError
from graphloom.operators.graph import FROM, LABELS, TO, TYPE, quoted
from graphloom.operators.versions import VersionedGraph
from graphloom.plans.ast import Clause, Create, Delete, MapOf, Match, Merge, Node, Path, Query, Remove, Return, SetItems, Subquery, Unary
from graphloom.plans.expressions import Bound, Translator
from graphloom.plans.planner import Binding, Planner, needs_of
from graphloom.sources import store

WRITES = (Create, Merge, Delete, SetItems, Remove)


def is_write(q: Query) -> bool:
    return any(isinstance(c, WRITES) for part in q.parts for c in part)


def _stored(kind: T.DataType) -> T.DataType:
    """The storage type for a value's type."""
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(20, 0) if kind.scale == 0 else T.DoubleType()
    if isinstance(kind, T.FractionalType):
        return T.DoubleType()
    if isinstance(kind, T.StringType | T.BooleanType):
        return kind
    raise AnalyzeError(f"a property can't hold {kind.simpleString()}")


class Writer:
    """One writing statement over one open change."""

    def __init__(self, planner: Planner, graph: VersionedGraph, change: int | None):
        if change is None:
            raise ExecError("writes need an open change")
        self.planner, self.graph, self.change = planner, graph, change
        self.buffer = graph.buffer(change)

    def run(self, clauses: list[Clause]) -> DataFrame:
        self.planner.needs = needs_of(clauses)
        for c in clauses:
            items = c.items if isinstance(c, SetItems | Remove) else [*c.on_create, *c.on_match] if isinstance(c, Merge) else []
            for name, *_ in items:  # a row that is replaced is read whole
                self.planner.needs.setdefault(name, set()).update({"*", LABELS, TYPE, FROM, TO})
        b = Binding()
        for c in clauses:
            if isinstance(c, Create):
                b = self.create(b, c.patterns)
            elif isinstance(c, Delete):
                self.delete(b, c.names)
            elif isinstance(c, SetItems):
                b = self.set(b, c.items)
            elif isinstance(c, Remove):
                b = self.set(b, [(n, ":-", labels[0]) if p == ":" else (n, p, None) for n, p, *labels in c.items])
            elif isinstance(c, Merge):
                b = self.merge(b, c)
            elif isinstance(c, Return):
                return self.planner.clause(c, b).df
            else:
                b = self.planner.clause(c, b)
        return self.planner.graph.spark.createDataFrame([], "done boolean")

    def frozen(self, b: Binding) -> Binding:
        """The binding written down, so that every later read sees the same rows."""
        part = store.write_part(self.planner.rows(b), f"{self.graph.folder}/scratch")
        return Binding(store.read_part(self.planner.graph.spark, part), b.scope)

    def learn(self, name: str, kind: T.DataType) -> T.DataType:
        """The type of a property that is written: the graph's, or a new one."""
        known = self.buffer.properties.get(name)
        if known is None:
            self.buffer.properties[name] = _stored(kind).simpleString()
            return _stored(kind)
        want = T._parse_datatype_string(known)
        whole = isinstance(kind, T.IntegralType | T.DecimalType)
        if isinstance(kind, T.NullType) or type(want) is type(_stored(kind)) or whole and isinstance(want, T.NumericType):
            return want
        raise AnalyzeError(f"the property {name} holds {known}, not {kind.simpleString()}")

    def create(self, b: Binding, patterns: list[Path]) -> Binding:
        new_nodes: list[Node] = []
        rels = []
        seen = dict(b.scope)
        for p in patterns:
            for n in p.nodes:
                if n.name in seen:
                    if (n.labels or n.props) and (n.name in b.scope or n not in new_nodes):
                        raise AnalyzeError(f"{n.name} is bound already")
                    continue
                if not n.labels:
                    raise AnalyzeError("a new node needs a label")
                new_nodes.append(n)
                seen[n.name] = Bound("node", n.name)
            for k, r in enumerate(p.rels):
                if len(r.types) != 1 or r.direction == "both" or r.hops is not None:
                    raise AnalyzeError("a new edge needs one type and a direction")
                if r.name in seen:
                    raise AnalyzeError(f"{r.name} is bound already")
                seen[r.name] = Bound("edge", r.name)
                a, z = p.nodes[k].name, p.nodes[k + 1].name
                rels.append((r, *((a, z) if r.direction == "out" else (z, a))))
        numbered = self.frozen(Binding(self.planner.rows(b).withColumn("  row", F.monotonically_increasing_id()), b.scope))
        df, scope = numbered.df, dict(b.scope)
        t = Translator(self.planner.graph, b.scope, self.planner.params)
        first_node, first_edge = self.buffer.next_node, self.buffer.next_edge
        columns = {}
        for j, n in enumerate(new_nodes):
            columns[n.name] = F.lit(first_node + j) + F.col("`  row`") * len(new_nodes)
            scope[n.name] = Bound("node", n.name, frozenset(n.labels))
        for j, (r, _, _) in enumerate(rels):
            columns[r.name] = F.lit(first_edge + j) + F.col("`  row`") * len(rels)
            scope[r.name] = Bound("edge", r.name)
        df = df.withColumns(columns)
        # properties are computed over the matched rows, and stand beside the new ids
        values = {}
        for x in (*new_nodes, *(r for r, _, _ in rels)):
            for k, v in x.props.items():
                c = t.column(v)
                kind = self.learn(k, df.select(c.alias("v")).schema["v"].dataType)
                values[f"{x.name}.{k}"] = c.cast(kind)
        df = df.withColumns(values)
        for n in new_nodes:
            self.buffer.labels += [x for x in n.labels if x not in self.buffer.labels]
            self.graph.add(self.change, "nodes", df.select(quoted(n.name).alias("id"), F.array(*(F.lit(x) for x in n.labels)).alias("labels"), *(quoted(f"{n.name}.{k}").alias(k) for k in n.props)))
        for r, a, z in rels:
            self.buffer.types += [x for x in r.types if x not in self.buffer.types]
            self.graph.add(self.change, "edges", df.select(quoted(r.name).alias("eid"), quoted(scope[a].column).alias("src"), quoted(scope[z].column).alias("dst"), F.lit(r.types[0]).alias("type"), *(quoted(f"{r.name}.{k}").alias(k) for k in r.props)))
        size = df.agg(F.count(F.lit(1)).alias("n"), F.max("`  row`").alias("last")).first()
        rows, last = size["n"], size["last"] if size["last"] is not None else -1
        self.buffer.nodes += rows * len(new_nodes)
        self.buffer.edges += rows * len(rels)
        self.buffer.next_node += (last + 1) * len(new_nodes)
        self.buffer.next_edge += (last + 1) * len(rels)
        # what RETURN may read of the new nodes and edges
        for x in (*new_nodes, *(r for r, _, _ in rels)):
            for p in self.planner.needs.get(x.name, set()):
                if not p.startswith(":") and p != "*" and p not in x.props:
                    df = df.withColumn(f"{x.name}.{p}", F.lit(None).cast(self.buffer.properties.get(p, "string")))
                elif p == LABELS and isinstance(x, Node):
                    df = df.withColumn(f"{x.name}.{LABELS}", F.array(*(F.lit(v) for v in x.labels)))
        for p, kind in self.buffer.properties.items():
            self.planner.graph.properties.setdefault(p, T._parse_datatype_string(kind))
        return Binding(df.drop("  row"), scope)

    def delete(self, b: Binding, names: list[str]) -> None:
        graph = self.planner.graph
        for name in names:
            if name not in b.scope:
                raise AnalyzeError(f"unknown variable: {name}")
            bound = b.scope[name]
            if bound.kind not in ("node", "edge"):
                raise AnalyzeError(f"{name} is neither a node nor an edge")
            ids = self.planner.rows(b).select(quoted(bound.column).alias("id" if bound.kind == "node" else "eid")).where(quoted("id" if bound.kind == "node" else "eid").isNotNull()).distinct()
            if bound.kind == "edge":
                self.graph.add(self.change, "dead_edges", ids)
                continue
            dead = self.graph.add(self.change, "dead_nodes", ids)
            edges = graph.all_edges().select("eid", "src", "dst")
            # a node's edges go with it
            gone = edges.join(dead, F.col("src") == F.col("id"), "left_semi").union(edges.join(dead, F.col("dst") == F.col("id"), "left_semi"))
            self.graph.add(self.change, "dead_edges", gone.select("eid").distinct())

    def set(self, b: Binding, items: list[tuple]) -> Binding:
        """Replace the rows of what is set. Of several values for one entity in one statement, one is kept.

        What was written before, and what is set, become pending commits, so that later statements of the change start from them.
        """
        b = self.frozen(b)
        self.flush()
        df, t = b.df, Translator(self.planner.graph, b.scope, self.planner.params)
        changed: dict[str, set[str]] = {}
        for name, what, *value in items:
            bound = t.bound(name)
            if bound.kind not in ("node", "edge"):
                raise AnalyzeError(f"{name} is neither a node nor an edge")
            changed.setdefault(name, set())
            if what in (":", ":-"):
                if bound.kind != "node":
                    raise AnalyzeError("only nodes have labels")
                labels = quoted(f"{bound.column}.{LABELS}")
                given = F.array(*(F.lit(x) for x in value[0]))
                df = df.withColumn(f"{bound.column}.{LABELS}", F.array_union(labels, given) if what == ":" else F.array_except(labels, given))
                self.buffer.labels += [x for x in value[0] if x not in self.buffer.labels]
                continue
            if what == "+=":
                if not isinstance(value[0], MapOf):
                    raise PlanError("+= needs a map")
                pairs = list(value[0].items.items())
            else:
                pairs = [(what, value[0])]
            for prop, e in pairs:
                c = F.lit(None) if e is None else t.column(e)
                kind = df.select(c.alias("v")).schema["v"].dataType
                if isinstance(kind, T.NullType) and prop not in self.buffer.properties:
                    continue
                df = df.withColumn(f"{bound.column}.{prop}", c.cast(self.learn(prop, kind)))
                changed[name].add(prop)
        for name in changed:
            bound = b.scope[name]
            props = [c[len(bound.column) + 1 :] for c in df.columns if c.startswith(bound.column + ".") and not c.startswith(bound.column + ".:")]
            rows = df.where(quoted(bound.column).isNotNull()).dropDuplicates([bound.column])
            values = [quoted(f"{bound.column}.{p}").alias(p) for p in props if p in self.buffer.properties]
            if bound.kind == "node":
                new = rows.select(quoted(bound.column).alias("id"), quoted(f"{bound.column}.{LABELS}").alias("labels"), *values)
                kept = self.graph.add(self.change, "nodes", new)
                self.graph.add(self.change, "old_nodes", kept.select("id"))
            else:
                new = rows.select(quoted(bound.column).alias("eid"), quoted(f"{bound.column}.{FROM}").alias("src"), quoted(f"{bound.column}.{TO}").alias("dst"), quoted(f"{bound.column}.{TYPE}").alias("type"), *values)
                kept = self.graph.add(self.change, "edges", new)
                self.graph.add(self.change, "old_edges", kept.select("eid"))
        for p, kind in self.buffer.properties.items():
            self.planner.graph.properties.setdefault(p, T._parse_datatype_string(kind))
        self.flush()
        return Binding(df, b.scope)

    def flush(self) -> None:
        if self.buffer.parts:
            self.graph.commit(self.change)
            self.buffer = self.graph.buffer(self.change)

    def merge(self, b: Binding, m: Merge) -> Binding:
        """Match a pattern for each row, or create it where it doesn't match.

        Rows that miss the same pattern (equal values, equal bound nodes) create it once: the first creates, the others match what it made.
        """
        mark = "  merge"
        rows = self.frozen(Binding(self.planner.rows(b).withColumn(mark, F.monotonically_increasing_id()), {**b.scope, mark: Bound("int", mark)}))
        found, missing = None, rows
        if self.known(m.pattern):
            found = self.frozen(self.planner.clause(Match([m.pattern]), rows))
            missing = Binding(rows.df.join(found.df.select(mark), mark, "left_anti").select(*(quoted(c) for c in rows.df.columns)), rows.scope)
            if m.on_match:
                found = self.set(found, m.on_match)
        t = Translator(self.planner.graph, rows.scope, self.planner.params)
        values = [quoted(rows.scope[n.name].column) for n in m.pattern.nodes if n.name in rows.scope]
        values += [t.column(v) for x in (*m.pattern.nodes, *m.pattern.rels) if x.name not in rows.scope for v in x.props.values()]
        keys = F.struct(F.lit(0).alias("k"), *(v.alias(f"k{j}") for j, v in enumerate(values))).alias("  key")
        keyed = missing.df.withColumn("  key", keys)
        first = keyed.groupBy("  key").agg(F.min(mark).alias("  first"))
        missing = self.frozen(Binding(keyed.join(first, "  key").drop("  key"), missing.scope))
        makers = Binding(missing.df.where(quoted(mark) == quoted("  first")).drop("  first"), missing.scope)
        made = self.create(makers, [m.pattern])
        if m.on_create:
            made = self.set(made, m.on_create)
        new = [c for c in made.df.columns if c not in rows.df.columns]
        others = missing.df.where(quoted(mark) != quoted("  first"))
        others = others.join(made.df.select(quoted(mark).alias("  made"), *(quoted(c) for c in new)), quoted("  first") == quoted("  made"))
        again = Binding(others.select(*(quoted(c) for c in made.df.columns)), made.scope)
        if m.on_match and not again.df.isEmpty():
            again = self.set(again, m.on_match)
        parts = [x.df for x in (found, made, again) if x is not None]
        both = [quoted(c) for c in parts[0].columns if c != mark and all(c in df.columns for df in parts)]
        df = parts[0].select(*both)
        for part in parts[1:]:
            df = df.union(part.select(*both))
        return Binding(df, {n: x for n, x in made.scope.items() if n != mark})

    def known(self, path: Path) -> bool:
        """Do all names of a pattern exist, so that it can match at all?"""
        graph = self.planner.graph
        names = {k for x in (*path.nodes, *path.rels) for k in x.props}
        return names <= set(graph.properties) and {x for n in path.nodes for x in n.labels} <= set(graph.labels) and {x for r in path.rels for x in r.types} <= set(graph.types)


