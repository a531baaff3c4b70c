"""The engine: a catalog of graphs and one entry for statements.

A graph is either versioned (written by statements, in commits) or a view of tables, which can't be written. Every statement gives a
DataFrame; reads are lazy, commands and writes are done when query() returns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import AnalyzeError, ExecError, GraphNotFound, PlanError
from graphloom.functions.procedures import procedure
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.versions import VersionedGraph
from graphloom.plans.ast import Command, Query
from graphloom.plans.parser import parse
from graphloom.plans.planner import Planner
from graphloom.plans.writes import Writer, is_write
from graphloom.sources import store
from graphloom.sources.gml import EDGE_TYPE, NODE_LABEL, parse_gml
from graphloom.sources.neo4j_json import read_export

_NAME = re.compile(r"[A-Za-z0-9_]+")


@dataclass
class Context:
    """What a statement knows of where it runs."""

    engine: Engine
    graph: VersionedGraph | PropertyGraph
    commit: str | None = None
    change: int | None = None

    def history(self) -> list[tuple[str, int, int, int]]:
        return self.graph.history(self.commit, self.change) if isinstance(self.graph, VersionedGraph) else []


@dataclass
class Engine:
    """folder: where graphs are kept, in a file system that driver and executors share; in_memory: nothing is listed there for later sessions."""

    spark: SparkSession
    folder: str | None = None
    in_memory: bool = False
    graphs: dict[str, VersionedGraph | PropertyGraph] = field(default_factory=dict)
    credentials: bool = False

    def __post_init__(self):
        if self.folder is None:
            shared = self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.spark.conf.get("spark.sql.warehouse.dir")
            self.folder, self.in_memory = f"{shared.rstrip('/')}/graphs-{self.spark.sparkContext.applicationId}", True
        self.folder = self.folder.rstrip("/")
        if "default" in self.available():
            self.load("default")
        else:
            self.create("default")

    # catalog

    def available(self) -> list[str]:
        """Graphs on disk."""
        return [n for n in store.children(self.spark, f"{self.folder}/graphs") if store.exists(self.spark, f"{self.folder}/graphs/{n}/commits")]

    def loaded(self) -> list[str]:
        return sorted(self.graphs)

    def register(self, name: str, graph: PropertyGraph) -> None:
        """A graph over tables under a name."""
        self._free(name)
        self.graphs[name] = graph

    def _free(self, name: str) -> None:
        if not _NAME.fullmatch(name):
            raise AnalyzeError(f"a graph's name has letters, digits and _ only: {name}")
        if name in self.graphs:
            raise ExecError(f"there is a graph {name} already")

    def create(self, name: str) -> VersionedGraph:
        self._free(name)
        if name in self.available():
            raise ExecError(f"there is a graph {name} already")
        g = VersionedGraph(self.spark, name, f"{self.folder}/graphs/{name}", not self.in_memory)
        g.save(0)
        self.graphs[name] = g
        return g

    def load(self, name: str) -> VersionedGraph:
        if name in self.graphs:
            raise ExecError(f"the graph {name} is loaded already")
        if name not in self.available():
            raise GraphNotFound(f"no graph {name}")
        self.graphs[name] = VersionedGraph.load(self.spark, name, f"{self.folder}/graphs/{name}")
        return self.graphs[name]

    def graph(self, name: str = "default") -> VersionedGraph | PropertyGraph:
        if name not in self.graphs:
            raise GraphNotFound(f"no graph {name}")
        return self.graphs[name]

    def view(self, name: str = "default", commit: str | None = None, change: int | None = None) -> PropertyGraph:
        g = self.graph(name)
        return g.view(commit, change) if isinstance(g, VersionedGraph) else g

    def status(self, name: str) -> dict[str, object]:
        """Is a graph loaded, and how many live nodes and edges does it have?"""
        if name not in self.graphs:
            return {"name": name, "isLoaded": False, "nodeCount": 0, "edgeCount": 0}
        v = self.view(name)
        return {"name": name, "isLoaded": True, "nodeCount": v.scan_nodes().count(), "edgeCount": v.scan_edges([(t, "src") for t in v.edges], "e", "a", "b").count()}

    # statements

    def query(self, text: str, graph: str = "default", commit: str | None = None, change: int | None = None, params: dict[str, object] | None = None) -> DataFrame:
        """Run a text's statements in order; the last one's result."""
        out = None
        for s in parse(text):
            out = self.command(s, graph, change) if isinstance(s, Command) else self.statement(s, graph, commit, change, params)
        return out

    def statement(self, q: Query, graph: str, commit: str | None, change: int | None, params: dict[str, object] | None) -> DataFrame:
        g = self.graph(graph)
        planner = Planner(self.view(graph, commit, change), params, Context(self, g, commit, change))
        if not is_write(q):
            df = planner.query(q)
            if q.mode:
                text = df._jdf.queryExecution().toString()
                return self.spark.createDataFrame([(line,) for line in text.splitlines()], "plan string")
            return df
        if not isinstance(g, VersionedGraph):
            raise ExecError(f"the graph {graph} is a view of tables")
        if len(q.parts) > 1:
            raise PlanError("a union can't write")
        return Writer(planner, g, change).run(q.parts[0])

    def command(self, c: Command, graph: str, change: int | None) -> DataFrame:
        one = lambda name, value: self.spark.createDataFrame([(value,)], f"{name} {'long' if isinstance(value, int) else 'string'}")
        nothing = self.spark.createDataFrame([], "done boolean")
        if c.kind == "create_graph":
            return one("graphName", self.create(str(c.args["name"])).name)
        if c.kind == "list_graph":
            return self.spark.createDataFrame([(n,) for n in self.loaded()], "graphName string")
        if c.kind == "load_graph":
            return one("graphName", self.load(str(c.args["name"])).name)
        if c.kind in ("load_gml", "load_neo4j"):
            path = str(c.args["path"])
            name = str(c.args["name"] or re.sub(r"\W", "_", path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or path.rstrip("/").rpartition("/")[2]))
            return one("graphName", (self.load_gml if c.kind == "load_gml" else self.load_export)(path, name).name)
        if c.kind == "show_procedures":
            return procedure("db.procedures")(self.view(graph), None)
        if c.kind == "s3_connect":
            return self.connect(str(c.args["key"]), str(c.args["secret"]), str(c.args["region"]))
        if c.kind in ("s3_pull", "s3_push"):
            if not self.credentials:
                raise ExecError("S3 CONNECT comes first")
            source, target = str(c.args["source"]), str(c.args["target"])
            far = source if c.kind == "s3_pull" else target
            if not far.startswith("s3://"):
                raise ExecError(f"{far} is no s3:// address")
            if c.kind == "s3_pull":
                store.copy(self.spark, source.replace("s3://", "s3a://", 1), self.inside(target))
            else:
                store.copy(self.spark, self.inside(source), target.replace("s3://", "s3a://", 1))
            return nothing
        g = self.graph(graph)
        if not isinstance(g, VersionedGraph):
            raise ExecError(f"the graph {graph} is a view of tables")
        if c.kind == "change_new":
            return one("changeID", g.new_change())
        if c.kind == "change_list":
            return self.spark.createDataFrame([(n,) for n in sorted(g.changes)], "changeID long")
        if change is None:
            raise ExecError("this needs an open change")
        if c.kind == "change_submit":
            g.submit(change)
        elif c.kind == "change_delete":
            g.drop_change(change)
        else:
            g.commit(change)
            return nothing
        return one("changeID", change)

    # imports

    def inside(self, path: str) -> str:
        """A path within the data folder."""
        if ".." in path.split("/"):
            raise ExecError(f"{path} leaves the data folder")
        folder = self.folder.rstrip("/")
        return path if path == folder or path.startswith(f"{folder}/") else f"{folder}/data/{path.lstrip('/')}"

    def connect(self, key: str, secret: str, region: str) -> DataFrame:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in (("fs.s3a.access.key", key), ("fs.s3a.secret.key", secret), ("fs.s3a.endpoint.region", region)):
            conf.set(k, v)
        self.credentials = True
        return self.spark.createDataFrame([], "done boolean")

    def import_frames(self, name: str, nodes: DataFrame, edges: DataFrame) -> VersionedGraph:
        """A new graph of one commit. nodes: id, labels, properties; edges: eid, src, dst, type, properties."""
        g = self.create(name)
        number = g.new_change()
        n, e = g.add(number, "nodes", nodes), g.add(number, "edges", edges)
        b = g.buffer(number)
        b.labels = sorted(r["x"] for r in n.select(F.explode("labels").alias("x")).distinct().collect())
        b.types = sorted(r["type"] for r in e.select("type").distinct().collect())
        b.properties = {f.name: f.dataType.simpleString() for df, own in ((n, ("id", "labels")), (e, ("eid", "src", "dst", "type"))) for f in df.schema.fields if f.name not in own}
        sizes = n.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).first(), e.agg(F.count(F.lit(1)).alias("n"), F.max("eid").alias("m")).first()
        b.nodes, b.edges = sizes[0]["n"], sizes[1]["n"]
        b.next_node, b.next_edge = (sizes[0]["m"] if b.nodes else -1) + 1, (sizes[1]["m"] if b.edges else -1) + 1
        g.submit(number)
        return g

    def load_gml(self, path: str, name: str) -> VersionedGraph:
        """A GML file as a graph. The file is read on the driver, as its nested lists can't be split."""
        text = store.read_text(self.spark, self.inside(path))
        nodes, edges = parse_gml(text)

        def frame(rows: list[dict], head: str, fixed) -> DataFrame:
            kinds = {"Int64": "long", "Double": "double", "String": "string", "Bool": "boolean"}
            props = list(dict.fromkeys(k for r in rows for k in r["props"]))
            ddl = head + "".join(f", `{p}` {kinds[p.rpartition('(')[2][:-1]]}" for p in props)
            return self.spark.createDataFrame([(*fixed(k, r), *(r["props"].get(p) for p in props)) for k, r in enumerate(rows)], ddl)

        n = frame(nodes, "id long, labels array<string>", lambda k, r: (r["id"], [NODE_LABEL]))
        e = frame(edges, "eid long, src long, dst long, type string", lambda k, r: (k, r["src"], r["dst"], EDGE_TYPE))
        return self.import_frames(name, n, e)

    def load_export(self, path: str, name: str) -> VersionedGraph:
        """A folder of JSON exports as a graph. Binary dumps need the other database to be opened, and are refused."""
        if path.endswith(".dump"):
            raise ExecError("a binary dump must be exported to JSON first")
        return self.import_frames(name, *read_export(self.spark, self.inside(path)))

    def import_path(self, path: str, name: str) -> VersionedGraph:
        """Load what lies at a path by what it is: a GML file, a folder of JSON exports, or a saved graph's folder."""
        if path.endswith(".gml"):
            return self.load_gml(path, name)
        full = self.inside(path)
        if store.exists(self.spark, f"{full}/commits"):
            self._free(name)
            self.graphs[name] = VersionedGraph.load(self.spark, name, full)
            return self.graphs[name]
        return self.load_export(path, name)
