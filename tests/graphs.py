"""Small graphs for tests, and a nested-loop matcher to hold results against."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from graphloom.operators.graph import EdgeTable, NodeTable, PropertyGraph


@dataclass
class Plain:
    """nodes: id -> (labels, properties); edges: (eid, src, dst, type, properties)."""

    nodes: dict[int, tuple[set, dict]] = field(default_factory=dict)
    edges: list[tuple] = field(default_factory=list)

    def frames(self, spark):
        kinds = {str: "string", int: "long", float: "double", bool: "boolean"}

        def props(rows):
            return {k: kinds[type(v)] for r in rows for k, v in r.items()}

        np, ep = props(p for _, p in self.nodes.values()), props(e[4] for e in self.edges)
        n = spark.createDataFrame([(i, sorted(l), *(p.get(k) for k in np)) for i, (l, p) in self.nodes.items()], "id long, labels array<string>" + "".join(f", {k} {t}" for k, t in np.items()))
        e = spark.createDataFrame([(*x[:4], *(x[4].get(k) for k in ep)) for x in self.edges], "eid long, src long, dst long, type string" + "".join(f", {k} {t}" for k, t in ep.items()))
        return n, e

    def graph(self, spark) -> PropertyGraph:
        """One table of nodes and one of edges, with labels and types in columns."""
        n, e = self.frames(spark)
        return PropertyGraph(spark, [NodeTable(n)], [EdgeTable(e)], sorted({x for l, _ in self.nodes.values() for x in l}), sorted({e[3] for e in self.edges}))

    def split(self, spark) -> PropertyGraph:
        """A table for each label set and for each edge type with its ends' label sets."""
        n, e = self.frames(spark)
        sets = sorted({frozenset(l) for l, _ in self.nodes.values()}, key=sorted)
        nodes = [NodeTable(n.where(n.id.isin([i for i, (l, _) in self.nodes.items() if l == s])).drop("labels"), s) for s in sets]
        edges = []
        for key in sorted({(x[3], frozenset(self.nodes[x[1]][0]), frozenset(self.nodes[x[2]][0])) for x in self.edges}, key=str):
            own = [x[0] for x in self.edges if (x[3], frozenset(self.nodes[x[1]][0]), frozenset(self.nodes[x[2]][0])) == key]
            edges.append(EdgeTable(e.where(e.eid.isin(own)).drop("type"), key[0], key[1], key[2]))
        return PropertyGraph(spark, nodes, edges)

    def match(self, nodes: list[tuple[str, set]], hops: list[tuple[str, str, str | None, str]]) -> list[dict]:
        """All bindings of node variables (name, labels) joined by hops (from, direction, type, to); every edge may be used again."""
        out = []
        for ids in product(*([i for i, (l, _) in self.nodes.items() if want <= l] for _, want in nodes)):
            b = {name: i for (name, _), i in zip(nodes, ids)}
            ways = 1
            for a, direction, kind, z in hops:
                n = 0
                for _, s, d, t, _ in self.edges:
                    if kind is None or t == kind:
                        n += direction in ("out", "both") and (s, d) == (b[a], b[z])
                        n += direction in ("in", "both") and (d, s) == (b[a], b[z])
                ways *= n
            out += [b] * ways
        return out


def social() -> Plain:
    """People, interests and cities, with missing properties, a loop, parallel edges and a node without edges."""
    g = Plain()
    people = [("Ana", 31, True), ("Bo", 45, False), ("Cy", None, True), ("Di", 28, None), ("Ed", 31, False)]
    for k, (name, age, member) in enumerate(people):
        g.nodes[k] = ({"Person", "Maker"} if k % 2 == 0 else {"Person"}, {x: v for x, v in (("name", name), ("age", age), ("member", member)) if v is not None})
    for k, name in enumerate(("Chess", "Tea", "Maps", None)):
        g.nodes[10 + k] = ({"Interest"}, {"name": name} if name else {})
    for k, name in enumerate(("Oslo", "Rome")):
        g.nodes[20 + k] = ({"City"}, {"name": name, "size": 0.5 + k})
    pairs = [(0, 1, "KNOWS"), (1, 0, "KNOWS"), (1, 2, "KNOWS"), (2, 0, "KNOWS"), (3, 3, "KNOWS"), (0, 10, "LIKES"), (1, 10, "LIKES"), (1, 10, "LIKES"), (2, 11, "LIKES"), (3, 12, "LIKES"), (0, 12, "LIKES"), (0, 20, "LIVES_IN"), (1, 21, "LIVES_IN"), (2, 20, "LIVES_IN")]
    g.edges = [(k, a, b, t, {"since": 2000 + k} if k % 3 else {}) for k, (a, b, t) in enumerate(pairs)]
    return g
