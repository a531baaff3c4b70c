"""A command line for the engine: python -m graphloom.shell [-dir FOLDER] [-load GRAPH] [-in-memory] [-q QUERY]."""

from __future__ import annotations

import argparse
import shlex
import subprocess
import sys
import time

from graphloom.engine import Engine
from graphloom.errors import GraphError
from graphloom.sources.results import table

HELP = """q, quit, exit: leave            help: this text
cd GRAPH: use a graph           checkout HASH | change-N | head: read a commit, or work in a change
quiet, unquiet: hide or show rows   read FILE: run a file's statements
sh, shell COMMAND: run a system command   anything else: a statement"""


class Shell:
    """What a session remembers: graph, commit, change and whether rows are shown."""

    def __init__(self, engine: Engine, out=sys.stdout):
        self.engine, self.out = engine, out
        self.graph, self.commit, self.change, self.quiet = "default", None, None, False

    def say(self, text: object) -> None:
        print(text, file=self.out)

    def run(self, line: str) -> bool:
        """One line; False to leave."""
        line = line.strip()
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        try:
            if word in ("q", "quit", "exit"):
                return False
            if not line:
                return True
            if word == "help":
                self.say(HELP)
            elif word == "cd":
                self.engine.graph(rest or "default")
                self.graph, self.commit, self.change = rest or "default", None, None
            elif word == "checkout":
                self.checkout(rest)
            elif word in ("quiet", "unquiet"):
                self.quiet = word == "quiet"
            elif word == "read":
                with open(rest) as f:
                    self.statement(f.read())
            elif word in ("sh", "shell"):
                self.say(subprocess.run(shlex.split(rest), capture_output=True, text=True).stdout.rstrip())
            else:
                self.statement(line)
        except (GraphError, OSError) as e:
            self.say(f"{getattr(e, 'status', 'ERROR')}: {e}")
        return True

    def checkout(self, what: str) -> None:
        commit, change = self.commit, self.change
        if what.startswith("change-"):
            commit, change = None, int(what.removeprefix("change-"))
        elif what in ("", "head", "main"):
            commit = change = None
        else:
            commit = what
        self.engine.view(self.graph, commit, change)
        self.commit, self.change = commit, change

    def statement(self, text: str) -> None:
        began = time.perf_counter()
        df = self.engine.query(text, self.graph, self.commit, self.change)
        shown = table(df)
        if not self.quiet:
            self.say(shown)
        self.say(f"{(time.perf_counter() - began) * 1000:.0f} ms")
        if self.change is not None and self.change not in getattr(self.engine.graph(self.graph), "changes", {}):
            self.change = None  # it was submitted or dropped


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("-dir", help="folder of the graphs")
    parser.add_argument("-load", action="append", default=[], help="graph to load; may be repeated")
    parser.add_argument("-in-memory", action="store_true", dest="in_memory")
    parser.add_argument("-q", dest="query", help="run this and leave")
    a = parser.parse_args(arguments)
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("graphloom").getOrCreate(), a.dir, a.in_memory)
    for name in a.load:
        engine.load(name)
    shell = Shell(engine)
    if a.query:
        shell.run(a.query)
        return 0
    while True:
        try:
            line = input(f"{shell.graph}> ")
        except EOFError:
            return 0
        if not shell.run(line):
            return 0


if __name__ == "__main__":
    sys.exit(main())
