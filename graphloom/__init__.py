"""Property-graph analytics on Spark: openCypher queries compiled to DataFrames, versioned graphs, exploration and search."""

from graphloom.errors import AnalyzeError, ChangeNotFound, CommitNotFound, ExecError, GraphError, GraphNotFound, ParseError, PlanError

__all__ = ["AnalyzeError", "ChangeNotFound", "CommitNotFound", "ExecError", "GraphError", "GraphNotFound", "ParseError", "PlanError"]
