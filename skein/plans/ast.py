"""Syntax tree of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """An expression; ``text`` is how it was written, which names unaliased columns."""

    text: str = ""


@dataclass
class Lit(Expr):
    value: Any


@dataclass
class Param(Expr):
    name: str


@dataclass
class Var(Expr):
    name: str


@dataclass
class Prop(Expr):
    of: Expr
    key: str


@dataclass
class HasLabels(Expr):
    of: Expr
    labels: list[str]


@dataclass
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class Un(Expr):
    op: str
    of: Expr


@dataclass
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass
class Case(Expr):
    of: Expr | None
    whens: list[tuple[Expr, Expr]]
    default: Expr | None


@dataclass
class ListLit(Expr):
    items: list[Expr]


@dataclass
class MapLit(Expr):
    items: dict[str, Expr]


@dataclass
class ListComp(Expr):
    var: str
    of: Expr
    where: Expr | None
    value: Expr | None


@dataclass
class Quant(Expr):
    kind: str
    var: str
    of: Expr
    where: Expr


@dataclass
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    of: Expr
    value: Expr


@dataclass
class Index(Expr):
    of: Expr
    at: Expr


@dataclass
class Slice(Expr):
    of: Expr
    low: Expr | None
    high: Expr | None


@dataclass
class NodePat:
    var: str | None
    labels: list[str]
    props: dict[str, Expr]


@dataclass
class RelPat:
    var: str | None
    types: list[str]
    props: dict[str, Expr]
    direction: str  # out, in, both
    span: tuple[int, int | None] | None = None


@dataclass
class Pattern:
    nodes: list[NodePat]
    rels: list[RelPat]
    path: str | None = None
    shortest: str | None = None  # one, all


@dataclass
class Exists(Expr):
    patterns: list[Pattern]
    where: Expr | None
    implicit: bool = False
    query: Query | None = None


@dataclass
class PatternComp(Expr):
    pattern: Pattern
    where: Expr | None
    value: Expr


@dataclass
class ShortestPath(Expr):
    pattern: Pattern


@dataclass
class Item:
    expr: Expr
    alias: str | None


@dataclass
class Projection:
    items: list[Item]
    star: bool
    distinct: bool
    order: list[tuple[Expr, bool]]  # ascending
    skip: Expr | None
    limit: Expr | None


@dataclass
class Clause:
    pass


@dataclass
class Match(Clause):
    patterns: list[Pattern]
    where: Expr | None
    optional: bool


@dataclass
class Unwind(Clause):
    of: Expr
    var: str


@dataclass
class With(Clause):
    body: Projection
    where: Expr | None


@dataclass
class Return(Clause):
    body: Projection


@dataclass
class SubQuery(Clause):
    query: Query


@dataclass
class CallProc(Clause):
    name: str
    args: list[Expr] | None
    yields: list[tuple[str, str]] | None
    star: bool = False
    where: Expr | None = None


@dataclass
class Create(Clause):
    patterns: list[Pattern]


@dataclass
class SetItem:
    kind: str  # prop, replace, merge, labels
    target: Expr
    key: str | None = None
    value: Expr | None = None
    labels: list[str] = field(default_factory=list)


@dataclass
class Merge(Clause):
    pattern: Pattern
    on_create: list[SetItem]
    on_match: list[SetItem]


@dataclass
class SetClause(Clause):
    items: list[SetItem]


@dataclass
class Remove(Clause):
    items: list[SetItem]


@dataclass
class Delete(Clause):
    of: list[Expr]
    detach: bool


@dataclass
class Foreach(Clause):
    var: str
    of: Expr
    body: list[Clause]


@dataclass
class Schema(Clause):
    """CREATE, DROP or SHOW of indexes and constraints."""

    action: str
    what: str
    label: str | None = None
    prop: str | None = None
    kind: str | None = None


@dataclass
class Query:
    clauses: list[Clause]
    union: tuple[bool, Query] | None = None  # (all, the rest)


WRITES = (Create, Merge, SetClause, Remove, Delete, Foreach)


def walk(node: Any):
    """All dataclass nodes below and including ``node``."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        for x in node.values():
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))
