"""Procedures: built in, registered on a graph, or given as mock tables in the parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.errors import ProcedureError
from skein.functions.typed import Typed, equal, is_bool, is_int, is_node, is_null, is_num, is_rel, is_string, literal
from skein.sources.graph import Graph

_KINDS = {"STRING": is_string, "INTEGER": is_int, "FLOAT": is_num, "NUMBER": is_num, "BOOLEAN": is_bool, "NODE": is_node, "RELATIONSHIP": is_rel, "ANY": lambda t: True}


def _names(graph: Graph, column: str, values: list[str]) -> DataFrame:
    return graph.spark.createDataFrame([(v,) for v in values], f"{column} string")


#: Procedures that give back their first argument, and under which name.
ECHOES = {"test.my.proc": "out"}

BUILT_IN = {
    "db.labels": lambda g: _names(g, "label", g.labels()),
    "db.relationshipTypes": lambda g: _names(g, "relationshipType", g.relationship_types()),
    "db.propertyKeys": lambda g: _names(g, "propertyKey", g.property_keys()),
    "dbms.components": lambda g: g.spark.createDataFrame([("skein", ["1"], "community")], "name string, versions array<string>, edition string"),
    "test.doNothing": lambda g: g.spark.range(1).select(),
    "test.labels": lambda g: _names(g, "label", g.labels()),
}


def call(graph: Graph, name: str, args: list[Typed] | None, params: dict[str, Any]) -> tuple[DataFrame, dict[str, str], Column | None]:
    """The procedure's rows, the column of each field, and on what they join the calling rows."""
    mocks = params.get("__procedures") or {}
    if name in mocks:
        return _mock(graph, name, mocks[name], args, params)
    if name in graph.procedures:
        table = graph.procedures[name](graph, *(args or []))
    elif name in BUILT_IN:
        if args:
            raise ProcedureError("InvalidNumberOfArguments", name)
        table = BUILT_IN[name](graph)
    else:
        raise ProcedureError("ProcedureNotFound", name)
    renamed = {c: f"__p_{c}" for c in table.columns}
    return table.withColumnsRenamed(renamed), renamed, None


def _mock(graph: Graph, name: str, mock: dict[str, Any], args: list[Typed] | None, params: dict[str, Any]):
    wanted = mock.get("args", [])
    if args is None:  # arguments are taken from parameters of their names
        missing = [a for a in wanted if a not in params]
        if missing:
            raise ProcedureError("MissingParameter", missing[0])
        args = [literal(params[a]) for a in wanted]
    if len(args) != len(wanted):
        raise ProcedureError("InvalidNumberOfArguments", name)
    for a, kind in zip(args, mock.get("arg_types", []), strict=False):
        fine = _KINDS[kind.rstrip("?").upper()]
        if not (is_null(a.type) or fine(a.type)):
            raise ProcedureError("InvalidArgumentType", f"{name} needs {kind}")
    columns = [*wanted, *mock.get("yields", [])]
    kinds = {}
    for c in columns:
        values = [r.get(c) for r in mock.get("data", []) if r.get(c) is not None]
        kinds[c] = literal(values[0]).type if values else literal("").type
        if values and any(isinstance(v, float) for v in values):
            kinds[c] = literal(1.0).type
    schema = ", ".join(f"`__p_{c}` {t.simpleString()}" for c, t in kinds.items())
    cast = lambda c, v: float(v) if isinstance(v, int) and not isinstance(v, bool) and kinds[c] == literal(1.0).type else v
    rows = [tuple(cast(c, r.get(c)) for c in columns) for r in mock.get("data", [])]
    table = graph.spark.createDataFrame(rows, schema) if columns else graph.spark.range(len(rows) or 1).select()
    join = None
    for a, c in zip(args, wanted, strict=True):
        x = Typed(F.col(f"__p_{c}"), kinds[c])
        one = x.col.isNull() if is_null(a.type) else equal(a, x)
        join = one if join is None else join & one
    return table, {c: f"__p_{c}" for c in mock.get("yields", [])}, join
