"""Graph views: named queries whose results are kept and refreshed.

FULL recomputes.  IMMEDIATE recomputes within each commit, and undoes a commit that a
constraint view rejects.  DIFFERENTIAL looks only at what writers touched.  It keeps, for each
branch of a UNION, the rows of its pattern with the ids they follow from; rows that a touched
node or an end of a touched relationship is part of are dropped and matched again.  Aggregates
and DISTINCT are kept by group, and the groups of dropped or new rows are made again from the
kept rows.  AUTO takes DIFFERENTIAL where it applies: one pattern of single hops, WHERE and RETURN.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.errors import ViewError
from skein.functions.exprs import AGGREGATES
from skein.plans import ast as A
from skein.plans.parser import parse
from skein.sources.graph import Graph
from skein.sources.storage import materialise
from skein.streaming.changes import ChangeFeed, touched

MODES = ("AUTO", "FULL", "DIFFERENTIAL", "IMMEDIATE")
_UNSTEADY = {"rand", "randomuuid", "startnode", "endnode", "timestamp"}


@dataclass
class Branch:
    """One branch of a view: the query of its kept rows, and what makes groups of them."""

    query: A.Query
    nodes: list[A.NodePat]
    ids: list[str]
    groups: list[str] | None
    body: A.Projection | None
    rows: DataFrame | None = None
    made: DataFrame | None = None


@dataclass
class View:
    name: str
    text: str
    params: dict[str, Any]
    schedule: str | None
    mode: str
    constraint: bool
    query: A.Query
    reads: set[str] = field(default_factory=set)
    rows: DataFrame | None = None
    seen: Graph | None = None
    branches: list[Branch] = field(default_factory=list)


def _aggregates(x: Any) -> bool:
    return any(isinstance(y, A.Call) and y.name in AGGREGATES for y in A.walk(x))


def _name(item: A.Item) -> str:
    return item.alias or (item.expr.name if isinstance(item.expr, A.Var) else item.expr.text)


def branch_of(clauses: list[A.Clause]) -> Branch | None:
    """How to maintain one branch by deltas; None if it has to be recomputed."""
    if len(clauses) != 2 or not isinstance(clauses[0], A.Match) or not isinstance(clauses[1], A.Return):
        return None
    m, body = clauses[0], clauses[1].body
    if m.optional or len(m.patterns) != 1 or body.order or body.skip or body.limit or body.star:
        return None
    p = m.patterns[0]
    if p.path or p.shortest or any(r.span for r in p.rels):
        return None
    if any(isinstance(x, (A.Exists, A.PatternComp, A.ShortestPath)) or isinstance(x, A.Call) and x.name in _UNSTEADY for x in A.walk(clauses)):
        return None
    nodes = [A.NodePat(n.var or f"__n{k}", n.labels, n.props) for k, n in enumerate(p.nodes)]
    rels = [A.RelPat(r.var or f"__r{k}", r.types, r.props, r.direction) for k, r in enumerate(p.rels)]
    parts = list(dict.fromkeys(x.var for x in (*nodes, *rels)))
    ids = [A.Item(A.Call("id", [A.Var(v)]), f"__id{k}") for k, v in enumerate(parts)]
    match = A.Match([A.Pattern(nodes, rels)], m.where, False)
    query = lambda items: A.Query([match, A.Return(A.Projection([*items, *ids], False, False, [], None, None))])
    if not body.distinct and not any(_aggregates(i.expr) for i in body.items):
        return Branch(query(body.items), nodes, [i.alias for i in ids], None, None)
    kept, again, groups = [], [], []
    for k, item in enumerate(body.items):
        if not _aggregates(item.expr):
            groups.append(f"__g{k}")
            kept.append(A.Item(item.expr, f"__g{k}"))
            again.append(A.Item(A.Var(f"__g{k}"), _name(item)))
        elif isinstance(item.expr, A.Call) and item.expr.name in AGGREGATES:
            call = item.expr
            if call.args and not call.star:
                kept.append(A.Item(call.args[0], f"__a{k}"))
                call = A.Call(call.name, [A.Var(f"__a{k}"), *call.args[1:]], call.distinct)
            again.append(A.Item(call, _name(item)))
        else:
            return None
    return Branch(query(kept), nodes, [i.alias for i in ids], groups, A.Projection([*again, A.Item(A.Var("__key"), "__key")], False, body.distinct, [], None, None))


def branches_of(q: A.Query) -> list[Branch] | None:
    out, rest = [], q
    while rest is not None:
        one = branch_of(rest.clauses)
        if one is None:
            return None
        out.append(one)
        rest = rest.union[1] if rest.union else None
    return out


class Views:
    def __init__(self, graph: Graph) -> None:
        self.graph = graph
        self.views: dict[str, View] = {}
        graph.listeners.append(self._committed)

    def create(self, name: str, text: str, params: dict[str, Any] | None = None, schedule: str | None = None, mode: str = "AUTO", constraint: bool = False, reads: tuple[str, ...] = ()) -> View:
        """``reads`` names views that this one is to be refreshed after."""
        if not re.fullmatch(r"[a-z_][a-z0-9_]{0,47}", name):
            raise ViewError("InvalidViewName", name)
        if name in self.views:
            raise ViewError("ViewExists", name)
        if mode not in MODES:
            raise ViewError("InvalidRefreshMode", mode)
        if constraint and mode not in ("IMMEDIATE", "AUTO"):
            raise ViewError("ConstraintNeedsImmediate", name)
        query = parse(text)
        if any(isinstance(x, A.WRITES) for x in A.walk(query)):
            raise ViewError("UnsupportedClause", "a view cannot write")
        branches = branches_of(query)
        if mode == "DIFFERENTIAL" and branches is None:
            raise ViewError("UnsupportedForDifferential", "only MATCH one pattern of single hops, WHERE and RETURN are maintained by deltas")
        missing = set(reads) - self.views.keys()
        if missing:
            raise ViewError("ViewNotFound", min(missing))
        if constraint:
            mode = "IMMEDIATE"
        elif mode == "AUTO":
            mode = "DIFFERENTIAL" if branches is not None else "FULL"
        view = View(name, text, params or {}, schedule, mode, constraint, query, set(reads), branches=branches or [])
        self._full(view, self.graph)
        self._require_empty(view)
        self.views[name] = view
        return view

    def drop(self, name: str) -> None:
        if any(name in v.reads for v in self.views.values()):
            raise ViewError("ViewInUse", name)
        if self.views.pop(name, None) is None:
            raise ViewError("ViewNotFound", name)

    def list(self) -> DataFrame:
        rows = [(v.name, v.text, v.mode, v.schedule, v.constraint) for v in self.views.values()]
        return self.graph.spark.createDataFrame(rows, "name string, query string, mode string, schedule string, constraint boolean")

    def dependencies(self, name: str) -> dict[str, list[str]]:
        v = self._get(name)
        nodes = [x for x in A.walk(v.query) if isinstance(x, A.NodePat)]
        rels = [x for x in A.walk(v.query) if isinstance(x, A.RelPat)]
        return {"labels": sorted({y for x in nodes for y in x.labels}), "types": sorted({y for x in rels for y in x.types}), "views": sorted(v.reads)}

    def read(self, name: str) -> DataFrame:
        """The kept rows, also as a temporary view of that name."""
        rows = self._get(name).rows
        rows.createOrReplaceTempView(name)
        return rows

    def refresh(self, name: str | None = None) -> list[str]:
        """Bring a view, or all of them in the order of their dependencies, up to date."""
        order = self.order() if name is None else [name]
        for n in order:
            v = self._get(n)
            if v.mode == "DIFFERENTIAL" and v.seen is not None:
                self._delta(v)
            else:
                self._full(v, self.graph)
        return order

    def order(self) -> list[str]:
        out: list[str] = []

        def visit(n: str) -> None:
            for r in sorted(self.views[n].reads):
                if r not in out:
                    visit(r)
            if n not in out:
                out.append(n)

        for n in self.views:
            visit(n)
        return out

    def follow(self, feed: ChangeFeed, checkpoint: str) -> None:
        """Refresh everything for what the feed has gained since the last call, exactly once per file."""

        def apply(batch: DataFrame, _: int) -> None:
            if not batch.where("op NOT IN ('Begin', 'Commit')").isEmpty():
                self.refresh()

        feed.stream().writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    # --- parts

    def _get(self, name: str) -> View:
        if name not in self.views:
            raise ViewError("ViewNotFound", name)
        return self.views[name]

    def _full(self, v: View, graph: Graph) -> None:
        v.seen = graph.snapshot()
        if v.mode != "DIFFERENTIAL":
            v.rows = materialise(graph.query(v.text, v.params))
            return
        for b in v.branches:
            b.rows = materialise(self._key(b, _rows(graph, b.query, v.params)))
            b.made = None if b.groups is None else materialise(_grouped(graph, b, b.rows, v.params))
        self._assemble(v)

    def _key(self, b: Branch, rows: DataFrame) -> DataFrame:
        """Rows with the text of their group, by which groups are told apart."""
        if b.groups is None:
            return rows
        parts = [F.col(f"{g}.id").alias(g) if "p" in getattr(rows.schema[g].dataType, "names", ()) else F.col(g) for g in b.groups]
        return rows.withColumn("__key", F.to_json(F.struct(F.lit(0).alias("_"), *parts)))

    def _assemble(self, v: View) -> None:
        parts = [b.rows.drop(*b.ids) if b.groups is None else b.made.drop("__key") for b in v.branches]
        rows = reduce(DataFrame.unionAll, parts)
        rest = v.query
        once = False
        while rest.union:
            once, rest = once or not rest.union[0], rest.union[1]
        v.rows = rows.distinct() if once else rows

    def _delta(self, v: View) -> None:
        now = self.graph.snapshot()
        nodes = touched(v.seen, now, "node")
        if nodes is None:
            self._full(v, self.graph)
            return
        ends = nodes
        rels = [x for b in v.branches for x in A.walk(b.query) if isinstance(x, A.RelPat)]
        types = set() if any(not r.types for r in rels) else {t for r in rels for t in r.types}
        if rels and any(k == "edge" and (not types or t is None or t in types) for k, _, t in now.touched[len(v.seen.touched) :]):
            edges = materialise(touched(v.seen, now, "edge", types)).withColumnRenamed("id", "__edge")
            # Tables that writes left alone hold the same edges before and after.
            tables = {id(e.df): e.df for g in (v.seen, now) for e in g.edge_tables(list(types))}
            for df in tables.values():
                hit = df.join(edges, F.col("id") == F.col("__edge"), "left_semi")
                ends = ends.unionAll(hit.select(F.col("source").alias("id"))).unionAll(hit.select(F.col("target").alias("id")))
        moved = materialise(ends.select(F.col("id").alias("__moved")).distinct())
        for b in v.branches:
            if not self._delta_of(v, b, moved):
                self._full(v, self.graph)
                return
        self._assemble(v)
        v.seen = now

    def _delta_of(self, v: View, b: Branch, moved: DataFrame) -> bool:
        """Bring one branch up to date; not where columns have changed their types."""
        places = [f"__id{k}" for k in range(len({n.var for n in b.nodes}))]
        stay = b.rows
        for place in places:
            stay = stay.join(moved, F.col(place) == F.col("__moved"), "left_anti")
        fresh = []
        for k, var in enumerate(dict.fromkeys(n.var for n in b.nodes)):
            rows = _rows(self.graph, b.query, v.params, var, moved)
            for before in places[:k]:  # found from there already
                rows = rows.join(moved, F.col(before) == F.col("__moved"), "left_anti")
            fresh.append(self._key(b, rows))
        if any(f.schema.simpleString() != b.rows.schema.simpleString() for f in fresh):
            return False
        new = materialise(reduce(DataFrame.unionAll, fresh))
        old = b.rows
        b.rows = materialise(stay.unionAll(new))
        if b.groups is not None:
            left = reduce(DataFrame.unionAll, (old.join(moved, F.col(p) == F.col("__moved"), "left_semi") for p in places))
            keys = materialise(left.select("__key").unionAll(new.select("__key")).distinct().withColumnRenamed("__key", "__of"))
            if not b.groups:
                b.made = materialise(_grouped(self.graph, b, b.rows, v.params))
                return True
            again = _grouped(self.graph, b, b.rows.join(keys, F.col("__key") == F.col("__of"), "left_semi"), v.params)
            if again.schema.simpleString() != b.made.schema.simpleString():
                return False
            b.made = materialise(b.made.join(keys, F.col("__key") == F.col("__of"), "left_anti").unionAll(again))
        return True

    def _require_empty(self, v: View) -> None:
        if v.constraint and not v.rows.isEmpty():
            raise ViewError("ConstraintViolated", v.name)

    def _committed(self, before: Graph, after: Graph) -> None:
        for name in self.order():
            v = self.views[name]
            if v.mode == "IMMEDIATE":
                self._full(v, after)
                try:
                    self._require_empty(v)
                except ViewError:
                    after.restore(before)
                    self._full(v, after)
                    raise


def _rows(graph: Graph, query: A.Query, params: dict[str, Any], var: str | None = None, moved: DataFrame | None = None) -> DataFrame:
    """The rows of a query; with ``var``, only those where it is one of the ``moved`` nodes."""
    from skein.operators.compile import Compiler, State

    compiler = Compiler(graph, params, query)
    state = State()
    if var is not None:
        pat = next(n for n in query.clauses[0].patterns[0].nodes if n.var == var)
        column = compiler.fresh(var)
        scan = graph.node_scan(pat.labels, compiler.wants(var, pat.props), column)
        scan = compiler.nothing(column) if scan is None else scan
        state = State(scan.join(moved, F.col(f"{column}.id") == F.col("__moved"), "left_semi"), {})
        state.scope[var] = compiler.bind(state.df, column)
    state = compiler.query(query, state)
    return compiler.rows(state).select(*(x.col.alias(n) for n, x in state.scope.items()))


def _grouped(graph: Graph, b: Branch, rows: DataFrame, params: dict[str, Any]) -> DataFrame:
    """The groups of kept rows, with their keys."""
    from skein.operators.compile import Compiler, State

    query = A.Query([A.Return(b.body)])
    compiler = Compiler(graph, params, query)
    state = State(rows, {c: compiler.bind(rows, c) for c in rows.columns})
    if not b.groups:  # without a group there is one row, also over nothing
        items = [i for i in b.body.items if i.alias != "__key"]
        state = compiler.project(state, A.Projection(items, False, b.body.distinct, [], None, None), [], final=True)
        return compiler.rows(state).select(*(x.col.alias(n) for n, x in state.scope.items()), F.lit("").alias("__key"))
    state = compiler.project(state, b.body, [], final=True)
    return compiler.rows(state).select(*(x.col.alias(n) for n, x in state.scope.items()))
