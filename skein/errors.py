"""Errors of the engine, each with a stable code and number.

Numbers: 100 elements of a graph, 200 its catalog, 300 queries, 600 views, 900 anything else.
"""

from __future__ import annotations

#: Numbers of codes that have one of their own; other codes have that of their kind.
NUMBERS = {
    "EntityNotFound": 100, "UnknownLabel": 200, "PathTooLong": 320, "InvalidViewName": 601, "UnsupportedClause": 601, "UnsupportedForDifferential": 601, "ConstraintNeedsImmediate": 601,
    "ViewExists": 602, "ViewNotFound": 603, "InvalidRefreshMode": 604, "ViewInUse": 606, "ConstraintViolated": 607,
}


class GraphError(Exception):
    """Base of all errors; ``code`` names the rule that was broken."""

    kind = "Error"
    family = 300

    def __init__(self, code: str, message: str = "") -> None:
        self.number = NUMBERS.get(code, self.family)
        super().__init__(f"{self.kind}.{code}" + (f": {message}" if message else ""))
        self.code = code


class QuerySyntaxError(GraphError):
    kind = "SyntaxError"


class QueryTypeError(GraphError):
    kind = "TypeError"


class ArgumentError(GraphError):
    kind = "ArgumentError"


class SemanticError(GraphError):
    kind = "SemanticError"


class ProcedureError(GraphError):
    kind = "ProcedureError"


class ConstraintError(GraphError):
    kind = "ConstraintViolation"
    family = 200


class ParameterMissing(GraphError):
    kind = "ParameterMissing"


class ViewError(GraphError):
    kind = "ViewError"
    family = 601
