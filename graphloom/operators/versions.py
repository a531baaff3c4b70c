"""Versioned graphs: immutable commits of parts and tombstones, changes that branch off and are submitted.

A commit lists parts (nodes and edges with their ids) and the ids that it deletes or replaces; a view folds them. Reads of a commit never
change. A change collects writes, which COMMIT turns into a pending commit of its own; CHANGE SUBMIT appends its commits to the
main line. If the main line moved on meanwhile, ids that both gave out are shifted, and conflicting writes are refused.
"""

from __future__ import annotations

import hashlib
import json
import threading
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import ChangeNotFound, CommitNotFound, ExecError
from graphloom.functions.procedures import value_type
from graphloom.operators.graph import EdgeTable, NodeTable, PropertyGraph
from graphloom.sources import store

NODE_SCHEMA = "id long, labels array<string>"
EDGE_SCHEMA = "eid long, src long, dst long, type string"
#: Kinds of rows that a commit holds.
KINDS = ("nodes", "edges", "dead_nodes", "dead_edges", "old_nodes", "old_edges")


@dataclass
class Commit:
    """What one commit adds: lists of parts by kind, where old_* are ids whose earlier rows are replaced.

    batches: the last batch of each stream, named by its checkpoint, that the graph holds at this commit.
    """

    hash: str
    parts: dict[str, list[dict]] = field(default_factory=dict)
    next_node: int = 0
    next_edge: int = 0
    nodes: int = 0
    edges: int = 0
    labels: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=1)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


@dataclass
class Change:
    """number; base: commits of the main line when it began; pending: its own commits; buffer: parts not yet in a commit."""

    number: int
    base: int
    pending: list[Commit] = field(default_factory=list)
    buffer: Commit | None = None


class VersionedGraph:
    """One graph's main line and open changes. folder: where its parts are, in a file system that the executors share."""

    def __init__(self, spark: SparkSession, name: str, folder: str, persistent: bool = True):
        self.spark, self.name, self.folder, self.persistent = spark, name, folder.rstrip("/"), persistent
        self.commits: list[Commit] = [Commit(hashlib.sha256(name.encode()).hexdigest()[:16])]
        self.changes: dict[int, Change] = {}
        self.numbers = 0
        self.lock = threading.Lock()

    # storage

    @classmethod
    def load(cls, spark: SparkSession, name: str, folder: str) -> VersionedGraph:
        g = cls(spark, name, folder)
        g.commits = [Commit(**m) for m in store.manifests(spark, g.folder)]
        return g

    def save(self, at: int) -> None:
        if self.persistent:
            store.write_text(self.spark, f"{self.folder}/commits/{at:08d}.json", self.commits[at].to_json())

    # views

    def find(self, commit: str | None, change: int | None) -> list[Commit]:
        """The commits that a transaction sees: with a change its own line, with a hash up to that commit, else the main line's head."""
        line = list(self.commits)
        if change is not None:
            c = self.change(change)
            own = self.commits[: c.base] + c.pending
            if commit is None or commit == "head":
                return own
            line = own if any(x.hash == commit for x in c.pending) else line
        if commit is None or commit == "head":
            return line
        for k, x in enumerate(line):
            if x.hash == commit:
                return line[: k + 1]
        raise CommitNotFound(f"no commit {commit}")

    def change(self, number: int) -> Change:
        if number not in self.changes:
            raise ChangeNotFound(f"no open change {number}")
        return self.changes[number]

    def rows(self, line: list[Commit], kind: str) -> DataFrame | None:
        """Live nodes or edges of a line of commits."""
        key, one = ("id", "nodes") if kind == "nodes" else ("eid", "edges")
        out: DataFrame | None = None
        for c in line:
            gone = _union([store.read_part(self.spark, p).select(F.col(key).alias("gone")) for k in (f"dead_{one}", f"old_{one}") for p in c.parts.get(k, [])])
            if gone is not None and out is not None:
                out = out.join(gone.distinct(), F.col(key) == F.col("gone"), "left_anti")
            new = _union([store.read_part(self.spark, p) for p in c.parts.get(one, [])])
            if new is not None:
                out = new if out is None else out.unionByName(new, allowMissingColumns=True)
        return out

    def view(self, commit: str | None = None, change: int | None = None) -> PropertyGraph:
        line = self.find(commit, change)
        nodes, edges = self.rows(line, "nodes"), self.rows(line, "edges")
        nodes = nodes if nodes is not None else self.spark.createDataFrame([], NODE_SCHEMA)
        edges = edges if edges is not None else self.spark.createDataFrame([], EDGE_SCHEMA)
        head = line[-1]
        properties = {n: T._parse_datatype_string(t) for n, t in head.properties.items()}
        return PropertyGraph(self.spark, [NodeTable(nodes)], [EdgeTable(edges)], list(head.labels), list(head.types), properties)

    def history(self, commit: str | None = None, change: int | None = None) -> list[tuple[str, int, int, int]]:
        out, nodes, edges, parts = [], 0, 0, 0
        for c in self.find(commit, change):
            nodes, edges, parts = nodes + c.nodes, edges + c.edges, parts + len(c.parts.get("nodes", []))
            out.append((c.hash, nodes, edges, parts))
        return out

    # changes

    def new_change(self) -> int:
        with self.lock:
            self.numbers += 1
            self.changes[self.numbers] = Change(self.numbers, len(self.commits))
            return self.numbers

    def drop_change(self, number: int) -> None:
        self.change(number)
        del self.changes[number]

    def buffer(self, number: int) -> Commit:
        """The open change's unwritten commit, with the catalog as it stands."""
        c = self.change(number)
        if c.buffer is None:
            last = (c.pending or self.commits[: c.base])[-1]
            c.buffer = Commit("", {}, last.next_node, last.next_edge, 0, 0, list(last.labels), list(last.types), dict(last.properties), dict(last.batches))
        return c.buffer

    def add(self, number: int, kind: str, df: DataFrame) -> DataFrame:
        """Write rows of a kind to an open change; they come back as written."""
        part = store.write_part(df, f"{self.folder}/parts")
        self.buffer(number).parts.setdefault(kind, []).append(part)
        return store.read_part(self.spark, part)

    def commit(self, number: int) -> None:
        """Turn an open change's writes into a commit of its own."""
        c = self.change(number)
        if c.buffer is not None:
            last = (c.pending or self.commits[: c.base])[-1]
            c.buffer.hash = hashlib.sha256(f"{last.hash}/{number}/{json.dumps(c.buffer.parts)}".encode()).hexdigest()[:16]
            c.pending.append(c.buffer)
            c.buffer = None

    def _ids(self, commits: list[Commit], *kinds: str) -> DataFrame | None:
        frames = [store.read_part(self.spark, p) for c in commits for k in kinds for p in c.parts.get(k, [])]
        return _union([df.select(F.col("id" if "id" in df.columns else "eid").alias("id")) for df in frames])

    def _check(self, ours: list[Commit], theirs: list[Commit], base: Commit) -> None:
        """Refuse writes that both sides made to the same nodes and edges."""

        def meet(a: DataFrame | None, b: DataFrame | None) -> bool:
            return a is not None and b is not None and not a.join(b, "id", "left_semi").isEmpty()

        def ends(commits: list[Commit]) -> DataFrame | None:
            frames = [store.read_part(self.spark, p) for c in commits for p in c.parts.get("edges", [])]
            return _union([df.select(F.col(end).alias("id")) for df in frames for end in ("src", "dst")])

        touched = self._ids(theirs, "dead_nodes", "old_nodes")
        new_ends = ends(ours)
        if meet(None if new_ends is None else new_ends.where(F.col("id") < base.next_node), touched):
            raise ExecError("conflict: a new edge touches a node that was written meanwhile")
        for one in ("nodes", "edges"):
            if meet(self._ids(ours, f"dead_{one}", f"old_{one}"), self._ids(theirs, f"dead_{one}", f"old_{one}")):
                raise ExecError(f"conflict: some {one} were written meanwhile")
        if meet(self._ids(ours, "dead_nodes"), ends(theirs)):
            raise ExecError("conflict: a deleted node has new edges")

    def submit(self, number: int) -> None:
        """Append an open change to the main line."""
        self.commit(number)
        with self.lock:
            c = self.change(number)
            base, theirs = self.commits[c.base - 1], self.commits[c.base :]
            if theirs:
                self._check(c.pending, theirs, base)
            head = self.commits[-1]
            nodes, edges = head.next_node - base.next_node, head.next_edge - base.next_edge
            for own in c.pending:
                if theirs:
                    # a property that both sides made with different types is told apart by its type
                    renamed = {n: f"{n} ({value_type(T._parse_datatype_string(k))})" for n, k in own.properties.items() if head.properties.get(n, k) != k}
                    own.properties = {renamed.get(n, n): k for n, k in own.properties.items()}
                    own.parts = {k: [self._shifted(p, base, nodes, edges, renamed) for p in parts] for k, parts in own.parts.items()}
                    own.next_node += nodes
                    own.next_edge += edges
                    own.labels = list(dict.fromkeys(head.labels + own.labels))
                    own.types = list(dict.fromkeys(head.types + own.types))
                    own.properties = {**head.properties, **own.properties}
                    own.batches = {x: max(head.batches.get(x, -1), own.batches.get(x, -1)) for x in head.batches | own.batches}
                self.commits.append(own)
                self.save(len(self.commits) - 1)
            del self.changes[number]

    def _shifted(self, part: dict, base: Commit, nodes: int, edges: int, renamed: dict[str, str]) -> dict:
        """A part with its own new ids moved past those given out meanwhile, and with other names for some properties."""
        df = store.read_part(self.spark, part)
        moved = df.withColumnsRenamed({a: b for a, b in renamed.items() if a in df.columns}) if set(renamed) & set(df.columns) else df
        for column, first, by in (("id", base.next_node, nodes), ("src", base.next_node, nodes), ("dst", base.next_node, nodes), ("eid", base.next_edge, edges)):
            if column in df.columns and by:
                moved = moved.withColumn(column, F.when(F.col(column) >= first, F.col(column) + by).otherwise(F.col(column)))
        return part if moved is df else store.write_part(moved, f"{self.folder}/parts")

    def merge(self) -> None:
        """Compact the main line to one commit of one part, without deleted rows. Ids stay."""
        with self.lock:
            if self.changes:
                raise ExecError("a graph with open changes can't be merged")
            head = self.commits[-1]
            parts = {}
            for kind in ("nodes", "edges"):
                rows = self.rows(self.commits, kind)
                if rows is not None:
                    parts[kind] = [store.write_part(rows, f"{self.folder}/parts")]
            live = {k: store.read_part(self.spark, parts[k][0]).count() if k in parts else 0 for k in ("nodes", "edges")}
            merged = Commit(hashlib.sha256(f"{head.hash}/merge".encode()).hexdigest()[:16], parts, head.next_node, head.next_edge, live["nodes"], live["edges"], head.labels, head.types, head.properties, head.batches)
            self.commits = [merged]
            if self.persistent:
                self.folder += "/merged"
                self.save(0)
