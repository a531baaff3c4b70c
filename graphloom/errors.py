"""One exception for each status that a query can end with."""


class GraphError(Exception):
    """Any failure of a query; status names its kind."""

    status = "ERROR"


class ParseError(GraphError):
    """The text isn't a statement."""

    status = "PARSE_ERROR"


class AnalyzeError(GraphError):
    """A name is unknown or types don't go together."""

    status = "ANALYZE_ERROR"


class PlanError(GraphError):
    """The statement has no plan."""

    status = "PLAN_ERROR"


class ExecError(GraphError):
    """The statement can't be carried out here and now."""

    status = "EXEC_ERROR"


class GraphNotFound(GraphError):
    """No graph has this name."""

    status = "GRAPH_NOT_FOUND"


class CommitNotFound(GraphError):
    """No commit has this hash."""

    status = "COMMIT_NOT_FOUND"


class ChangeNotFound(GraphError):
    """No open change has this number."""

    status = "CHANGE_NOT_FOUND"
