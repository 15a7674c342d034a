"""Error hierarchy of the graph engine."""


class GraphError(Exception):
    """Base of all errors of this package."""


class NodeNotFoundError(GraphError):
    pass


class EdgeNotFoundError(GraphError):
    pass


class CorruptedGraphError(GraphError):
    pass


class TransactionError(GraphError):
    pass


class MergeError(GraphError):
    pass


class AlreadyOpenError(GraphError):
    pass


class CapacityExceededError(GraphError):
    pass


class UsageError(GraphError):
    """A tool or command was used wrongly; the command line exits with 2."""
