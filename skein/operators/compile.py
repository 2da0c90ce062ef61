"""Queries to DataFrames.

Every variable is one typed column.  Patterns become joins, optional and existential ones
left, semi and anti joins on the ids they share with their surroundings; nothing is run again
per row.  Paths of bounded length are unrolled joins; unbounded ones grow a frontier.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import ArgumentError, ProcedureError, QuerySyntaxError, QueryTypeError
from skein.functions.exprs import AGGREGATES, Exprs
from skein.functions.typed import (
    BOOL, DOUBLE, LONG, STRING, Typed, common, equal, family, fit, group_key, is_entity, is_float, is_int, is_list, is_node, is_null, is_num, is_path, is_rel, order_key, shown,
)
from skein.plans import ast as A
from skein.plans.parser import parse
from skein.plans.uses import PARTS, needed
from skein.sources.graph import EdgeTable, Graph
from skein.sources.storage import materialise

#: Longest path; longer ones raise.
MAX_HOPS = 256
#: Bounded paths up to this length are unrolled; others write each step's frontier.
UNROLL = 6


@dataclass
class State:
    """Rows so far, and the column of each variable."""

    df: DataFrame | None = None
    scope: dict[str, Typed] = field(default_factory=dict)


@dataclass(frozen=True)
class PathWants:
    """Whether a named path's nodes are looked at, and which properties of its parts; None for all."""

    nodes: bool
    node_props: set[str] | None
    rel_props: set[str] | None


def both(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    return None if a is None or b is None else a | b


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any], query: A.Query) -> None:
        self.graph, self.params, self.spark = graph, params, graph.spark
        self.uses = needed(query)
        self.count = 0

    # --- small parts

    def fresh(self, name: str = "") -> str:
        self.count += 1
        return f"v{self.count}_{''.join(c if c.isalnum() else '_' for c in name)}"

    def wants(self, var: str | None, inline: dict[str, A.Expr]) -> set[str] | None:
        if var is None:
            return set(inline)
        if "*" in self.uses:
            return None
        found = self.uses.get(var, set())
        return None if found is None else found | set(inline)

    def path_wants(self, path: str | None) -> PathWants | None:
        if path is None:
            return None
        asked = None if "*" in self.uses else self.uses.get(path, set())
        if asked is None or asked - PARTS:
            return PathWants(True, None, None)
        return PathWants("nodes" in asked, self.uses.get(f"{path}.nodes", set()), self.uses.get(f"{path}.relationships", set()))

    def rows(self, state: State) -> DataFrame:
        return state.df if state.df is not None else self.spark.range(1).select(F.lit(1).alias("__one"))

    def bind(self, df: DataFrame, column: str) -> Typed:
        return Typed(F.col(f"`{column}`"), df.schema[column].dataType)

    def exprs(self, state: State, ready: dict[int, Typed] | None = None) -> Exprs:
        return Exprs(state.scope, self.params, ready)

    def add(self, state: State, var: str | None, x: Typed) -> State:
        column = self.fresh(var or "")
        df = self.rows(state).withColumn(column, x.col if not is_null(x.type) else F.lit(None).cast("string"))
        scope = dict(state.scope)
        if var:
            scope[var] = Typed(F.col(column), x.type)
        return State(df, scope)

    # --- queries

    def query(self, q: A.Query, state: State | None = None, keys: list[str] | None = None) -> State:
        """Compile a query; the result's scope holds its columns.  ``keys`` are columns that inner rows keep apart."""
        out = self.clauses(q.clauses, state or State(), keys or [])
        if q.union is None:
            return out
        every, rest = q.union
        other = self.query(rest, state, keys)
        if list(out.scope) != list(other.scope):
            raise QuerySyntaxError("DifferentColumnsInUnion", f"{list(out.scope)} and {list(other.scope)}")
        scope, left, right = {}, [], []
        for name, a in out.scope.items():
            b = other.scope[name]
            t = common(a.type, b.type) or STRING
            column = self.fresh(name)
            real = STRING if is_null(t) else t
            left.append(fit(a, real).alias(column))
            right.append(fit(b, real).alias(column))
            scope[name] = Typed(F.col(column), real)
        kept = [F.col(k) for k in keys or []]
        df = out.df.select(*kept, *left).unionAll(other.df.select(*kept, *right))
        return State(df if every else self.distinct(df, list(scope.values()), keys or []), scope)

    def clauses(self, clauses: list[A.Clause], state: State, keys: list[str]) -> State:
        from skein.operators import writes

        for k, c in enumerate(clauses):
            if isinstance(c, A.Match):
                state = self.optional(state, c) if c.optional else self.match(state, c.patterns, c.where)
            elif isinstance(c, A.Unwind):
                state = self.unwind(state, c)
            elif isinstance(c, (A.With, A.Return)):
                state = self.project(state, c.body, keys, final=isinstance(c, A.Return))
                if isinstance(c, A.With) and c.where is not None:
                    state = self.where(state, c.where)
            elif isinstance(c, A.SubQuery):
                state = self.subquery(state, c.query)
            elif isinstance(c, A.CallProc):
                state = self.procedure(state, c, alone=len(clauses) == 1)
            elif isinstance(c, A.Schema):
                state = writes.schema(self, c)
            else:
                state = writes.write(self, state, c)
                if k == len(clauses) - 1:
                    state = State(self.rows(state).limit(0).select(), {})
        return state

    # --- predicates

    def where(self, state: State, predicate: A.Expr) -> State:
        """Filter; pattern predicates among the conjuncts become semi and anti joins."""
        plain: list[A.Expr] = []
        for part in conjuncts(predicate):
            negated, inner = False, part
            while isinstance(inner, A.Un) and inner.op == "NOT":
                negated, inner = not negated, inner.of
            if isinstance(inner, A.Exists):
                state = self.semi(state, inner, negated)
            else:
                plain.append(part)
        for part in plain:
            state, ready = self.prepare(state, part)
            state = State(self.rows(state).where(self.exprs(state, ready).predicate(part)), state.scope)
        return state

    def prepare(self, state: State, *parts: Any) -> tuple[State, dict[int, Typed]]:
        """Join what pattern predicates, comprehensions and path functions in ``parts`` stand for."""
        ready: dict[int, Typed] = {}
        for e in self._special(list(parts)):
            if isinstance(e, A.Exists):
                keys, inner = self.matched(state, e.patterns, e.where, e.query)
                mark = self.fresh("exists")
                found = inner.df.select(*keys.values()).distinct().withColumn(mark, F.lit(True))
                state = State(self.left(state, found, keys), state.scope)
                ready[id(e)] = Typed(F.coalesce(F.col(mark), F.lit(False)), BOOL)
            elif isinstance(e, A.PatternComp):
                keys, inner = self.matched(state, [e.pattern], e.where)
                inner, more = self.prepare(inner, e.value)
                value = self.exprs(inner, more)(e.value)
                column = self.fresh("list")
                lists = inner.df.groupBy(*keys.values()).agg(F.collect_list(value.col).alias(column)) if keys else inner.df.agg(F.collect_list(value.col).alias(column))
                state = State(self.left(state, lists, keys), state.scope)
                t = T.ArrayType(value.type)
                ready[id(e)] = Typed(F.coalesce(F.col(column), F.array().cast(t)), t)
            elif isinstance(e, A.ShortestPath):
                ends = [n.var for n in e.pattern.nodes]
                if any(v is None or v not in state.scope for v in ends):
                    raise QuerySyntaxError("UndefinedVariable", "shortestPath() in an expression needs bound ends")
                name = self.fresh("sp")
                keys, inner = self.matched(state, [A.Pattern(e.pattern.nodes, e.pattern.rels, name, e.pattern.shortest)], None)
                path = inner.scope[name]
                column = self.fresh("path")
                gather = F.first(path.col) if e.pattern.shortest == "one" else F.collect_list(path.col)
                state = State(self.left(state, inner.df.groupBy(*keys.values()).agg(gather.alias(column)), keys), state.scope)
                ready[id(e)] = Typed(F.col(column), path.type if e.pattern.shortest == "one" else T.ArrayType(path.type))
            else:  # startNode, endNode
                rel = self.exprs(state, ready)(e.args[0])
                if not is_rel(rel.type):
                    raise QueryTypeError("InvalidArgumentType", f"{e.name}() of a {family(rel.type)}")
                name, key = self.fresh("end"), self.fresh("endid")
                nodes = self.graph.all_nodes(name)
                df = self.rows(state).withColumn(key, rel.col["source" if e.name == "startnode" else "target"])
                state = State(df.join(nodes, F.col(key) == F.col(f"{name}.id"), "left"), state.scope)
                ready[id(e)] = self.bind(state.df, name)
        return state, ready

    def _special(self, x: Any) -> list[A.Expr]:
        """Parts that need joins, outermost only, in order."""
        if isinstance(x, (A.Exists, A.PatternComp, A.ShortestPath)) or isinstance(x, A.Call) and x.name in ("startnode", "endnode"):
            return [x]
        if isinstance(x, (list, tuple)):
            return [y for v in x for y in self._special(v)]
        if isinstance(x, dict):
            return [y for v in x.values() for y in self._special(v)]
        if hasattr(x, "__dataclass_fields__"):
            return [y for n in x.__dataclass_fields__ for y in self._special(getattr(x, n))]
        return []

    def matched(self, state: State, patterns: list[A.Pattern], where: A.Expr | None, query: A.Query | None = None) -> tuple[dict[str, str], State]:
        """Match inside a subquery.

        Gives the outer variables it depends on, each with the column of the inner rows that
        tells which outer values a row belongs to, and those rows.
        """
        names = {v for p in patterns for x in (*p.nodes, *p.rels) if (v := x.var)}
        used = names | {x.name for x in A.walk([where, query, [x.props for p in patterns for x in (*p.nodes, *p.rels)]]) if isinstance(x, A.Var)}
        if query is not None:
            used |= {v for x in A.walk(query) if isinstance(x, (A.NodePat, A.RelPat)) and (v := x.var)}
        outer = [v for v in state.scope if v in used]
        if query is None and self.free_start(state, patterns, where, outer):
            # The only outer variable is a node that starts the pattern and is not looked into,
            # so the edges alone tell where matches start.
            var = outer[0]
            bare = State(None, {})
            inner = self.match(bare, patterns, where, stub=var)
            key = self.fresh("key")
            inner = State(inner.df.withColumn(key, inner.scope[var].col["id"]), inner.scope)
            return {var: key}, inner
        keys, columns, scope = {}, [], {}
        for v in outer:
            x, key, column = state.scope[v], self.fresh("key"), self.fresh(v)
            keys[v] = key
            columns += [group_key(x).alias(key), x.col.alias(column)]
            scope[v] = Typed(F.col(column), x.type)
        seeds = State(self.rows(state).select(*columns).dropDuplicates(list(keys.values())) if outer else None, scope)
        if query is not None:
            return keys, self.clauses(query.clauses, seeds, list(keys.values()))
        return keys, self.match(seeds, patterns, where)

    def free_start(self, state: State, patterns: list[A.Pattern], where: A.Expr | None, outer: list[str]) -> bool:
        if len(patterns) != 1 or len(outer) != 1 or patterns[0].shortest or patterns[0].path or not patterns[0].rels or patterns[0].rels[0].span:
            return False
        p, var = patterns[0], outer[0]
        inner_uses = {x.name for x in A.walk([where, [x.props for x in (*p.nodes, *p.rels)]]) if isinstance(x, A.Var)}
        first = p.nodes[0]
        return first.var == var and is_node(state.scope[var].type) and not first.labels and not first.props and var not in inner_uses and sum(n.var == var for n in p.nodes) == 1

    def left(self, state: State, found: DataFrame, keys: dict[str, str]) -> DataFrame:
        df = self.rows(state)
        return df.join(found, self.same(state, keys), "left") if keys else df.crossJoin(found) if len(found.columns) else df

    def same(self, state: State, keys: dict[str, str]) -> Column:
        out = None
        for v, key in keys.items():
            x = state.scope[v]
            one = x.col["id"] == F.col(key) if is_entity(x.type) else group_key(x).eqNullSafe(F.col(key))
            out = one if out is None else out & one
        return out

    def semi(self, state: State, e: A.Exists, negated: bool) -> State:
        if e.implicit:
            for n in (*e.patterns[0].nodes, *e.patterns[0].rels):
                if n.var and n.var not in state.scope:
                    raise QuerySyntaxError("UndefinedVariable", n.var)
        keys, inner = self.matched(state, e.patterns, e.where, e.query)
        df = self.rows(state)
        if not keys:
            some = inner.df.limit(1).select(F.lit(1).alias(self.fresh("some")))
            return State(df.join(some, F.lit(True), "left_anti" if negated else "left_semi"), state.scope)
        return State(df.join(inner.df.select(*keys.values()), self.same(state, keys), "left_anti" if negated else "left_semi"), state.scope)

    # --- patterns

    def optional(self, state: State, c: A.Match) -> State:
        keys, inner = self.matched(state, c.patterns, c.where)
        new = {v: x for v, x in inner.scope.items() if v not in state.scope}
        found = inner.df.select(*keys.values(), *(x.col for x in new.values()))
        if keys:
            df = self.rows(state).join(found, self.same(state, keys), "left")
        else:
            df = self.rows(state).join(found, F.lit(True), "left")
        return State(df, state.scope | new)

    def match(self, state: State, patterns: list[A.Pattern], where: A.Expr | None, stub: str | None = None) -> State:
        self.check_pattern_names(state, patterns)
        seen: list[tuple[Typed, list[EdgeTable]]] = []
        todo = list(patterns)
        while todo:
            # Patterns that touch what is bound come first, so joins replace products.
            k = next((k for k, p in enumerate(todo) if any(x.var in state.scope for x in (*p.nodes, *p.rels) if x.var)), 0)
            state = self.pattern(state, todo.pop(k), seen, stub, where)
        return self.where(state, where) if where is not None else state

    def check_pattern_names(self, state: State, patterns: list[A.Pattern]) -> None:
        kinds: dict[str, str] = {}
        for p in patterns:
            rels = [r.var for r in p.rels if r.var]
            if len(rels) != len(set(rels)):
                raise QuerySyntaxError("RelationshipUniquenessViolation", next(r for r in rels if rels.count(r) > 1))
            for kind, items in (("node", p.nodes), ("relationship", p.rels)):
                for x in items:
                    if x.var:
                        if kinds.setdefault(x.var, kind) != kind:
                            raise QuerySyntaxError("VariableTypeConflict", x.var)
                        if x.var in state.scope:
                            t = state.scope[x.var].type
                            fine = is_node(t) if kind == "node" else is_rel(t) or is_list(t)
                            if not fine and not is_null(t):
                                raise QuerySyntaxError("VariableTypeConflict", x.var)
            if p.path and (p.path in state.scope or p.path in kinds):
                raise QuerySyntaxError("VariableAlreadyBound", p.path)

    def pattern(self, state: State, p: A.Pattern, seen: list[tuple[Typed, list[EdgeTable]]], stub: str | None, where: A.Expr | None = None) -> State:
        if p.shortest:
            from skein.operators.shortest import shortest

            return shortest(self, state, p, where)
        n = len(p.nodes)
        start = next((k for k, x in enumerate(p.nodes) if x.var in state.scope), 0)
        if p.nodes[start].var not in state.scope and stub is None:
            # Start where the pattern says most: inline properties, then labels.
            start = max(range(n), key=lambda k: (len(p.nodes[k].props), len(p.nodes[k].labels) > 0, -k))
        columns: list[Typed | None] = [None] * n
        between: list[tuple[Typed, Typed | None] | None] = [None] * (n - 1)  # rel or rels, inner nodes
        path = self.path_wants(p.path)
        if not (stub is not None and p.nodes[start].var == stub):
            state, columns[start] = self.node(state, p.nodes[start], path)
        for k in [*range(start, n - 1), *range(start - 1, -1, -1)]:
            near, far = (k, k + 1) if k >= start else (k + 1, k)
            direction = p.rels[k].direction
            if near > far:
                direction = {"out": "in", "in": "out", "both": "both"}[direction]
            state, columns[near], between[k], columns[far] = self.hop(state, columns[near], p.nodes[near], p.rels[k], direction, p.nodes[far], seen, path, near > far)
        if path:
            state = self.named_path(state, p, columns, between)
        return state

    def node(self, state: State, pat: A.NodePat, path: PathWants | None = None) -> tuple[State, Typed]:
        if pat.var in state.scope:
            x = state.scope[pat.var]
            return self.restrict(state, x, pat), x
        name = self.fresh(pat.var or "n")
        scan = self.graph.node_scan(pat.labels, both(self.wants(pat.var, pat.props), path.node_props if path else set()), name)
        if scan is None:
            scan = self.nothing(name)
        df = scan if state.df is None else state.df.crossJoin(scan)
        x = self.bind(df, name)
        scope = state.scope | ({pat.var: x} if pat.var else {})
        return self.restrict(State(df, scope), x, A.NodePat(None, [], pat.props)), x

    def nothing(self, name: str) -> DataFrame:
        """No nodes at all."""
        empty = F.struct(F.lit(0).cast("long").alias("id"), F.array().cast("array<string>").alias("labels"), F.struct(F.lit(None).cast("string").alias("_")).alias("p"))
        return self.spark.range(0).select(empty.alias(name))

    def restrict(self, state: State, x: Typed, pat: A.NodePat) -> State:
        df = self.rows(state)
        for label in pat.labels:
            df = df.where(F.array_contains(x.col["labels"], label))
        state = State(df, state.scope)
        return self.inline(state, x, pat.props)

    def inline(self, state: State, x: Typed, props: dict[str, A.Expr]) -> State:
        for key, value in props.items():
            e = self.exprs(state)
            state = State(state.df.where(equal(e.property(x, key), e(value))), state.scope)
        return state

    def hop(self, state: State, near: Typed | None, near_pat: A.NodePat, rel: A.RelPat, direction: str, to: A.NodePat, seen: list, path: PathWants | None, backwards: bool) -> tuple[State, Typed, tuple[Typed, Typed | None], Typed]:
        tables = self.graph.edge_tables(rel.types)
        usable = [t for t in tables if self.fits_end(t, direction, to)]
        props = both(self.wants(rel.var, rel.props), path.rel_props if path else set())
        if rel.span:
            return self.stretch(state, near, near_pat, rel, direction, to, usable if len(to.labels) == 0 else tables, props, seen, path, backwards)
        prefix = self.fresh("e") + "_"
        if not usable:
            return self.dead_end(state, near, near_pat, rel, to)
        edges = self.graph.edge_scan(usable, props, direction, prefix)
        hit = F.col(f"{prefix}rel")
        scope = dict(state.scope)
        if near is None:  # start from the edges themselves
            name = self.fresh(near_pat.var or "n")
            df = edges.withColumn(name, self.bare(F.col(f"{prefix}near"), F.col(f"{prefix}near_labels")))
            near = self.bind(df, name)
            if near_pat.var:
                scope[near_pat.var] = near
        else:
            on = near.col["id"] == F.col(f"{prefix}near")
            if to.var in scope:
                on = on & (scope[to.var].col["id"] == F.col(f"{prefix}far"))
            if rel.var in scope:
                on = on & (scope[rel.var].col["id"] == hit["id"])
            df = state.df.join(edges, on)
        r = self.bind(df, f"{prefix}rel")
        state = State(df, scope)
        state = self.inline(state, r, rel.props)
        state = self.distinct_rels(state, r, usable, seen)
        if rel.var and rel.var not in scope:
            state.scope[rel.var] = r
        state, far = self.arrive(state, to, usable, direction, F.col(f"{prefix}far"), F.col(f"{prefix}far_labels"), path)
        return state, near, (r, None), far

    def bare(self, node_id: Column, labels: Column) -> Column:
        return F.struct(node_id.alias("id"), labels.alias("labels"), F.struct(F.lit(None).cast("string").alias("_")).alias("p"))

    def fits_end(self, t: EdgeTable, direction: str, to: A.NodePat) -> bool:
        ends = {"out": [t.target], "in": [t.source], "both": [t.source, t.target]}[direction]
        return not to.labels or any(e is None or set(to.labels) <= set(e) for e in ends)

    def arrive(self, state: State, to: A.NodePat, tables: list[EdgeTable], direction: str, far: Column, far_labels: Column, path: PathWants | None) -> tuple[State, Typed]:
        """Bind the node at the end of a hop, without a join where its id and labels suffice."""
        if to.var in state.scope:
            x = state.scope[to.var]
            state = State(state.df.where(x.col["id"] == far), state.scope)
            return self.restrict(state, x, to), x
        props = both(self.wants(to.var, to.props), path.node_props if path else set())
        ends = self.far_ends(tables, direction)
        name = self.fresh(to.var or "n")
        if props == set() and all(e is not None for e in ends):
            df = state.df.withColumn(name, self.bare(far, far_labels))
            if any(not set(to.labels) <= set(e) for e in ends):
                for label in to.labels:
                    df = df.where(F.array_contains(far_labels, label))
        else:
            scan = self.graph.node_scan(to.labels or self.shared_labels(ends), props, name)
            df = state.df.join(scan if scan is not None else self.nothing(name), far == F.col(f"{name}.id"))
        x = self.bind(df, name)
        state = State(df, state.scope | ({to.var: x} if to.var else {}))
        return self.inline(state, x, to.props), x

    def far_ends(self, tables: list[EdgeTable], direction: str) -> list[tuple[str, ...] | None]:
        return [e for t in tables for e in {"out": [t.target], "in": [t.source], "both": [t.source, t.target]}[direction]]

    def shared_labels(self, ends: list[tuple[str, ...] | None]) -> list[str]:
        """Labels that every possible end has, to scan fewer tables."""
        if not ends or any(e is None for e in ends):
            return []
        return sorted(set.intersection(*(set(e) for e in ends)))

    def dead_end(self, state: State, near: Typed | None, near_pat: A.NodePat, rel: A.RelPat, to: A.NodePat) -> tuple[State, Typed, tuple[Typed, None], Typed]:
        """A hop over relationships that do not exist."""
        name, at, end = self.fresh(rel.var or "r"), self.fresh(near_pat.var or "n"), self.fresh(to.var or "n")
        one = F.struct(F.lit(0).cast("long").alias("id"), F.lit("").alias("type"), F.lit(0).cast("long").alias("source"), F.lit(0).cast("long").alias("target"), F.struct(F.lit(None).cast("string").alias("_")).alias("p"))
        node = self.bare(F.lit(0).cast("long"), F.array().cast("array<string>"))
        kind = F.array(one) if rel.span else one
        df = self.rows(state).limit(0).select("*", kind.alias(name), node.alias(at), node.alias(end))
        scope = dict(state.scope)
        for var, column in ((rel.var, name), (to.var, end), (near_pat.var, at)):
            if var and var not in scope:
                scope[var] = self.bind(df, column)
        return State(df, scope), near or self.bind(df, at), (self.bind(df, name), None), scope.get(to.var) or self.bind(df, end)

    def distinct_rels(self, state: State, r: Typed, tables: list[EdgeTable], seen: list) -> State:
        """Relationships of one MATCH are pairwise different; only overlapping types are compared."""
        df = state.df
        for other, theirs in seen:
            if any(a is b for a in tables for b in theirs):
                df = df.where(apart(r, other))
        seen.append((r, tables))
        return State(df, state.scope)

    # --- paths of several hops

    def stretch(self, state: State, near: Typed | None, near_pat: A.NodePat, rel: A.RelPat, direction: str, to: A.NodePat, tables: list[EdgeTable], props: set[str] | None, seen: list, path: PathWants | None, backwards: bool):
        low, high = rel.span
        if near is None:
            state, near = self.node(state, near_pat)
        if rel.var in state.scope:
            return self.bound_stretch(state, near, rel, direction, to, path, backwards)
        if high is not None and high < low or not tables and low > 0:
            return self.dead_end(state, near, near_pat, rel, to)
        cur, at, rs, ns = self.fresh("cur"), self.fresh("at"), self.fresh("rels"), self.fresh("nodes")
        whole = rel.var is not None and (self.uses.get(rel.var, set()) is None or bool(self.uses.get(rel.var))) or path is not None and path.rel_props != set() or "*" in self.uses or bool(rel.props)
        rel_type = self.rel_type(tables, props if whole else set())
        inside = path is not None and path.nodes
        over = self.shared_labels(self.far_ends(tables, direction))
        passed = lambda name: self.graph.node_scan(over, path.node_props, name)
        node_type = (passed("n") if passed("n") is not None else self.nothing("n")).schema["n"].dataType if inside else None
        base = state.df.withColumn(cur, near.col["id"]).withColumn(at, near.col["labels"]).withColumn(rs, F.array().cast(T.ArrayType(rel_type)))
        if inside:
            base = base.withColumn(ns, F.array().cast(T.ArrayType(node_type)))
        earlier = [x for x, theirs in seen if any(a is b for a in tables for b in theirs)]

        def step(front: DataFrame) -> DataFrame:
            prefix = self.fresh("s") + "_"
            edges = self.graph.edge_scan(tables, props if whole else set(rel.props), direction, prefix)
            if rel.props:
                x = self.bind(edges, f"{prefix}rel")
                own = State(edges, {})
                for key, value in rel.props.items():
                    if any(isinstance(v, A.Var) for v in A.walk(value)):
                        raise QuerySyntaxError("UndefinedVariable", "properties of a path take constants")
                    own = State(own.df.where(equal(Exprs({}, self.params).property(x, key), Exprs({}, self.params)(value))), {})
                edges = own.df
            r = Typed(F.col(f"{prefix}rel"), edges.schema[f"{prefix}rel"].dataType)
            joined = front.join(edges, F.col(cur) == F.col(f"{prefix}near"))
            joined = joined.where(~F.exists(F.col(rs), lambda x: x["id"] == r.col["id"]))
            for other in earlier:
                joined = joined.where(apart(r, other))
            added = F.array(fit(r, rel_type))
            joined = joined.withColumn(rs, F.concat(added, F.col(rs)) if backwards else F.concat(F.col(rs), added)).withColumn(cur, F.col(f"{prefix}far")).withColumn(at, F.col(f"{prefix}far_labels"))
            if inside:
                name = self.fresh("m")
                joined = joined.join(passed(name), F.col(cur) == F.col(f"{name}.id"))
                m = F.array(fit(self.bind(joined, name), node_type))
                joined = joined.withColumn(ns, F.concat(m, F.col(ns)) if backwards else F.concat(F.col(ns), m))
            return joined.select(*front.columns)

        parts = [base] if low == 0 else []
        front = base
        if not tables:
            high = 0
        if high is not None and high <= UNROLL:
            for depth in range(1, high + 1):
                front = step(front)
                if depth >= low:
                    parts.append(front)
        else:
            for depth in range(1, min(high or MAX_HOPS, MAX_HOPS) + 1):
                front = materialise(step(front))
                if front.isEmpty():
                    break
                if depth >= low:
                    parts.append(front)
                if depth == MAX_HOPS:
                    raise ArgumentError("PathTooLong", f"paths of more than {MAX_HOPS} relationships")
        if not parts:
            return self.dead_end(state, near, near_pat, rel, to)
        df = parts[0]
        for part in parts[1:]:
            df = df.unionAll(part)
        r = self.bind(df, rs)
        seen.append((r, tables))
        state = State(df, state.scope | ({rel.var: r} if rel.var else {}))
        state, far = self.arrive_after(state, to, tables, direction, F.col(cur), F.col(at), path, low == 0)
        inner = None
        if inside:  # the nodes behind the pattern's left one, as it is written
            inner = self.bind(df, ns)
            if backwards:
                behind = F.concat(F.slice(inner.col, F.lit(2), F.greatest(F.lit(0), F.size(inner.col) - 1)), F.array(fit(near, node_type)))
                inner = Typed(F.when(F.size(inner.col) == 0, inner.col).otherwise(behind), inner.type)
        return state, near, (r, inner), far

    def arrive_after(self, state: State, to: A.NodePat, tables: list[EdgeTable], direction: str, at: Column, labels: Column, path: PathWants | None, zero: bool) -> tuple[State, Typed]:
        """Bind the node that steps over ``tables`` end at, or that they start from where there may be none."""
        known = all(e is not None for e in self.far_ends(tables, direction))
        if to.var not in state.scope and known and both(self.wants(to.var, to.props), path.node_props if path else set()) == set():
            name = self.fresh(to.var or "n")
            df = state.df.withColumn(name, self.bare(at, labels))
            for label in to.labels:
                df = df.where(F.array_contains(labels, label))
            x = self.bind(df, name)
            return State(df, state.scope | ({to.var: x} if to.var else {})), x
        if zero or to.labels:
            return self.arrive_at(state, to, at, path)
        return self.arrive(state, to, tables, direction, at, labels, path)

    def arrive_at(self, state: State, to: A.NodePat, at: Column, path: PathWants | None) -> tuple[State, Typed]:
        """Bind the node a path ends at."""
        return self.arrive(state, to, [EdgeTable("", None)], "out", at, F.lit(None).cast("array<string>"), path)

    def rel_type(self, tables: list[EdgeTable], props: set[str] | None) -> T.DataType:
        if not tables:
            return T.StructType([T.StructField("id", LONG), T.StructField("type", STRING), T.StructField("source", LONG), T.StructField("target", LONG), T.StructField("p", T.StructType([T.StructField("_", STRING)]))])
        return self.graph.edge_scan(tables, props, "out", "").schema["rel"].dataType

    def node_type(self, props: set[str] | None) -> T.DataType:
        return self.graph.all_nodes("n", props).schema["n"].dataType

    def bound_stretch(self, state: State, near: Typed, rel: A.RelPat, direction: str, to: A.NodePat, path: PathWants | None, backwards: bool):
        """A list of relationships that is already bound has to be a walk from the node."""
        rs = state.scope[rel.var]
        low, high = rel.span
        ordered = F.reverse(rs.col) if backwards else rs.col
        start = F.struct(near.col["id"].alias("at"), F.lit(True).alias("ok"))

        def follow(s: Column, r: Column) -> Column:
            ahead, back = s["at"] == r["source"], s["at"] == r["target"]
            if direction == "out":
                return F.struct(r["target"].alias("at"), (s["ok"] & ahead).alias("ok"))
            if direction == "in":
                return F.struct(r["source"].alias("at"), (s["ok"] & back).alias("ok"))
            return F.struct(F.when(ahead, r["target"]).otherwise(r["source"]).alias("at"), (s["ok"] & (ahead | back)).alias("ok"))

        walk = self.fresh("walk")
        df = state.df.withColumn(walk, F.aggregate(ordered, start, follow))
        df = df.where(F.col(walk)["ok"] & (F.size(rs.col) >= low))
        if high is not None:
            df = df.where(F.size(rs.col) <= high)
        state, far = self.arrive_at(State(df, state.scope), to, F.col(walk)["at"], path)
        return state, near, (rs, None), far

    def named_path(self, state: State, p: A.Pattern, columns: list[Typed], between: list) -> State:
        node_type: T.DataType | None = None
        rel_type: T.DataType | None = None
        for x in columns:
            node_type = x.type if node_type is None else common(node_type, x.type)
        for r, inner in between:
            one = r.type.elementType if is_list(r.type) else r.type
            rel_type = one if rel_type is None else common(rel_type, one)
            if inner is not None:
                node_type = common(node_type, inner.type.elementType)
        nodes, rels = [F.array(fit(columns[0], node_type))], []
        for k, (r, inner) in enumerate(between):
            if is_list(r.type):
                rels.append(fit(r, T.ArrayType(rel_type)))
                if inner is not None:  # the last of them is the far end itself
                    nodes.append(fit(inner, T.ArrayType(node_type)))
                    continue
            else:
                rels.append(F.array(fit(r, rel_type)))
            nodes.append(F.array(fit(columns[k + 1], node_type)))
        rel_list = F.concat(*rels) if rels else F.array().cast(T.ArrayType(self.rel_type([], None)))
        made = F.struct(F.concat(*nodes).alias("nodes"), rel_list.alias("rels"))
        return self.add(state, p.path, Typed(made, state.df.select(made.alias("p")).schema["p"].dataType))

    # --- rows and projections

    def unwind(self, state: State, c: A.Unwind) -> State:
        if c.var in state.scope:
            raise QuerySyntaxError("VariableAlreadyBound", c.var)
        state, ready = self.prepare(state, c.of)
        x = self.exprs(state, ready)(c.of)
        df, column = self.rows(state), self.fresh(c.var)
        if is_null(x.type) or is_list(x.type) and is_null(x.type.elementType):
            return State(df.limit(0).withColumn(column, F.lit(None).cast("string")), state.scope | {c.var: Typed(F.col(column), STRING)})
        listed = x.col if is_list(x.type) else F.when(x.col.isNotNull(), F.array(x.col))
        inner = x.type.elementType if is_list(x.type) else x.type
        return State(df.withColumn(column, F.explode(listed)), state.scope | {c.var: Typed(F.col(column), inner)})

    def distinct(self, df: DataFrame, columns: list[Typed], keys: list[str]) -> DataFrame:
        """One row per different combination; entities are told apart by their ids."""
        if not any(is_entity(x.type) or is_path(x.type) for x in columns):
            return df.distinct()
        named = {self.fresh("d"): x.col["id"] if is_entity(x.type) else F.transform(x.col["rels"], lambda r: r["id"]) if is_path(x.type) else x.col for x in columns}
        return df.withColumns(named).dropDuplicates([*keys, *named]).drop(*named)

    def project(self, state: State, body: A.Projection, keys: list[str], final: bool) -> State:
        items = list(body.items)
        if body.star:
            if not state.scope and not items:
                raise QuerySyntaxError("NoVariablesInScope", "* with nothing in scope")
            items = [A.Item(A.Var(v), v) for v in sorted(state.scope)] + items
        names = []
        for item in items:
            name = item.alias or (item.expr.name if isinstance(item.expr, A.Var) else item.expr.text)
            if not final and item.alias is None and not isinstance(item.expr, A.Var):
                raise QuerySyntaxError("NoExpressionAlias", item.expr.text)
            if any(isinstance(x, A.Exists) and x.implicit for x in A.walk(item.expr)):
                raise QuerySyntaxError("UnexpectedSyntax", "a pattern is no value")
            if name in names:
                raise QuerySyntaxError("ColumnNameConflict", name)
            names.append(name)
        aggregated = [any(is_aggregate(x) for x in A.walk(i.expr)) for i in items]
        for e in [body.skip, body.limit]:
            if e is not None and any(isinstance(x, A.Var) for x in A.walk(e)):
                raise QuerySyntaxError("NonConstantExpression", "SKIP and LIMIT take constants")
        if any(aggregated):
            state, values, ready = self.aggregate(state, items, aggregated, keys, body.order)
        else:
            if any(is_aggregate(x) for e, _ in body.order for x in A.walk(e)):
                raise QuerySyntaxError("InvalidAggregation", "ORDER BY an aggregate that is not projected")
            state, ready = self.prepare(state, [i.expr for i in items], [e for e, _ in body.order])
            e = self.exprs(state, ready)
            values = [e(i.expr) for i in items]
        columns = [self.fresh(n) for n in names]
        typed = [Typed(F.col(c), STRING if is_null(v.type) else v.type) for c, v in zip(columns, values, strict=True)]
        df = self.rows(state).withColumns({c: (F.lit(None).cast("string") if is_null(v.type) else v.col) for c, v in zip(columns, values, strict=True)}) if columns else self.rows(state)
        scope = dict(zip(names, typed, strict=True))
        hidden: list[tuple[str, bool]] = []
        if body.order:
            inner = scope if body.distinct or any(aggregated) else state.scope | scope
            known = {id(x): typed[k] for k, i in enumerate(items) for e, _ in body.order for x in A.walk(e) if isinstance(x, A.Expr) and not isinstance(x, A.Var) and x == i.expr}
            known |= {i: t for i, t in ready.items() if i not in known}
            for e, up in body.order:
                try:
                    key = Exprs(inner, self.params, known)(e)
                except QuerySyntaxError as problem:
                    if problem.code == "UndefinedVariable" and any(aggregated) and not body.distinct:
                        key = Exprs(state.scope | scope, self.params, known)(e)
                    else:
                        raise
                column = self.fresh("o")
                df = df.withColumn(column, order_key(key))
                hidden.append((column, up))
        kept = [*keys, *columns]
        if body.distinct:
            df = self.distinct(df.select(*kept, *(c for c, _ in hidden)), typed, [*keys, *(c for c, _ in hidden)])
        order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in hidden]
        skip, limit = (self.whole(e) if e is not None else None for e in (body.skip, body.limit))
        if keys and (skip or limit is not None):
            rank = self.fresh("rank")
            window = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))
            df = df.withColumn(rank, F.row_number().over(window))
            df = df.where((F.col(rank) > (skip or 0)) & (F.lit(True) if limit is None else F.col(rank) <= (skip or 0) + limit))
        else:
            if order and not keys:
                df = df.orderBy(*order)
            if skip:
                df = df.offset(skip)
            if limit is not None:
                df = df.limit(limit)
        return State(df.select(*kept), scope)

    def whole(self, e: A.Expr) -> int:
        if isinstance(e, A.Lit):
            value = e.value
        elif isinstance(e, A.Param):
            Exprs({}, self.params)(e)
            value = self.params[e.name]
        else:
            value = self.spark.range(1).select(Exprs({}, self.params)(e).col.alias("x")).first()["x"]
        if value is None:
            return 0
        if isinstance(value, bool) or not isinstance(value, int):
            raise QuerySyntaxError("InvalidArgumentType", f"{value!r} rows")
        if value < 0:
            raise QuerySyntaxError("NegativeIntegerArgument", str(value))
        return value

    # --- aggregation

    def aggregate(self, state: State, items: list[A.Item], aggregated: list[bool], keys: list[str], order: list[tuple[A.Expr, bool]]) -> tuple[State, list[Typed], dict[int, Typed]]:
        calls = [x for i, agg in zip(items, aggregated, strict=True) if agg for x in A.walk(i.expr) if is_aggregate(x)]
        calls += [x for e, _ in order for x in A.walk(e) if is_aggregate(x)]
        for c in calls:
            inner = [x for a in c.args for x in A.walk(a)]
            if any(is_aggregate(x) for x in inner):
                raise QuerySyntaxError("NestedAggregation", c.name)
            if any(isinstance(x, A.Call) and x.name in ("rand", "randomuuid") for x in inner):
                raise QuerySyntaxError("NonConstantExpression", "a random value inside an aggregate")
        key_items = [i.expr for i, agg in zip(items, aggregated, strict=True) if not agg]
        state, ready = self.prepare(state, key_items, [c.args for c in calls])
        e = self.exprs(state, ready)
        named = {self.fresh("k"): e(x) for x in key_items}
        df = self.rows(state).withColumns({n: (F.lit(None).cast("string") if is_null(x.type) else x.col) for n, x in named.items()}) if named else self.rows(state)
        made: dict[str, tuple[Column, T.DataType]] = {}
        columns: list[tuple[A.Call, str]] = []
        for c in calls:
            known = next((n for other, n in columns if other == c), None)
            if known is None:
                known = self.fresh("a")
                made[known] = aggregate_column(c, [e(a) for a in c.args], e)
            columns.append((c, known))
        grouped = df.groupBy(*keys, *named)
        out = grouped.agg(*(col.alias(n) for n, (col, _) in made.items())) if made else grouped.agg(F.count(F.lit(1)))
        after = {n: Typed(F.col(n), STRING if is_null(x.type) else x.type) for n, x in named.items()}
        done: dict[int, Typed] = {id(c): Typed(F.col(n), made[n][1]) for c, n in columns}
        scope = {x.name: after[n] for n, x in zip(named, key_items, strict=True) if isinstance(x, A.Var)}
        for i, agg in zip(items, aggregated, strict=True):
            for x in A.walk(i.expr) if agg else ():
                for n, key in zip(named, key_items, strict=True):
                    if isinstance(x, A.Expr) and id(x) not in done and x == key:
                        done[id(x)] = after[n]
        values = []
        order_of_keys = iter(after.values())
        for i, agg in zip(items, aggregated, strict=True):
            if not agg:
                values.append(next(order_of_keys))
                continue
            try:
                values.append(Exprs(scope, self.params, done)(i.expr))
            except QuerySyntaxError as problem:
                if problem.code == "UndefinedVariable":
                    raise QuerySyntaxError("AmbiguousAggregationExpression", i.expr.text) from None
                raise
        return State(out, scope), values, done

    # --- subqueries and procedures

    def subquery(self, state: State, q: A.Query) -> State:
        first = q.clauses[0]
        imported = [i.expr.name for i in first.body.items if isinstance(i.expr, A.Var)] if isinstance(first, A.With) and all(isinstance(i.expr, A.Var) and i.alias in (None, i.expr.name) for i in first.body.items) else []
        imported = [v for v in imported if v in state.scope]
        if not imported:
            inner = self.query(q)
            clash = [v for v in inner.scope if v in state.scope]
            if clash:
                raise QuerySyntaxError("VariableAlreadyBound", clash[0])
            return State(self.rows(state).crossJoin(inner.df.select(*(x.col for x in inner.scope.values()))), state.scope | inner.scope)
        keys, columns, scope = {}, [], {}
        for v in imported:
            x, key, column = state.scope[v], self.fresh("key"), self.fresh(v)
            keys[v] = key
            columns += [group_key(x).alias(key), x.col.alias(column)]
            scope[v] = Typed(F.col(column), x.type)
        seeds = State(self.rows(state).select(*columns).dropDuplicates(list(keys.values())), scope)
        inner = self.query(q, seeds, list(keys.values()))
        new = {v: x for v, x in inner.scope.items() if v not in state.scope}
        last = q.clauses[-1]
        alone = isinstance(last, A.Return) and last.body.items and all(any(is_aggregate(x) for x in A.walk(i.expr)) for i in last.body.items)
        found = inner.df.select(*keys.values(), *(x.col for x in new.values()))
        df = self.rows(state).join(found, self.same(state, keys), "left" if alone else "inner")
        if alone:  # an aggregate over no rows still has a value
            for item, name in zip(last.body.items, inner.scope, strict=True):
                empty = empty_value(item.expr, new[name])
                if empty is not None:
                    column = self.fresh(name)
                    df = df.withColumn(column, F.coalesce(new[name].col, empty))
                    new[name] = Typed(F.col(column), new[name].type)
        return State(df, state.scope | new)

    def procedure(self, state: State, c: A.CallProc, alone: bool) -> State:
        from skein.operators.procedures import ECHOES, call

        outer = self.exprs(state)
        args = [outer(a) for a in c.args] if c.args is not None else None
        for a in c.args or []:
            if any(is_aggregate(x) for x in A.walk(a)):
                raise QuerySyntaxError("InvalidAggregation", "an aggregate as an argument")
        if c.name in ECHOES and c.name not in (self.params.get("__procedures") or {}):
            if not args:
                raise ProcedureError("MissingParameter", f"{c.name} needs an argument")
            out = state
            for name, alias in c.yields if c.yields is not None else [(ECHOES[c.name], ECHOES[c.name])] if c.star or alone else []:
                if name != ECHOES[c.name]:
                    raise ProcedureError("ProcedureNotFound", f"{c.name} yields no {name}")
                if alias in out.scope:
                    raise QuerySyntaxError("VariableAlreadyBound", alias)
                out = self.add(out, alias, args[0])
            return self.where(out, c.where) if c.where is not None else out
        table, renamed, join = call(self.graph, c.name, args, self.params)
        yields = c.yields if c.yields is not None else [(n, n) for n in renamed] if c.star or alone else []
        df = self.rows(state)
        df = df.join(table, join) if join is not None else df.crossJoin(table)
        scope, picked = dict(state.scope), []
        for name, alias in yields:
            if name not in renamed:
                raise ProcedureError("ProcedureNotFound", f"{c.name} yields no {name}")
            if alias in scope:
                raise QuerySyntaxError("VariableAlreadyBound", alias)
            column = self.fresh(alias)
            picked.append(F.col(renamed[name]).alias(column))
            scope[alias] = Typed(F.col(column), table.schema[renamed[name]].dataType)
        kept = [x.col for x in state.scope.values()]
        out = State(df.select(*[k for k in df.columns if k not in table.columns], *picked) if kept or picked else df, scope)
        return self.where(out, c.where) if c.where is not None else out


# --- helpers


def conjuncts(e: A.Expr) -> list[A.Expr]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Bin) and e.op == "AND" else [e]


def apart(r: Typed, other: Typed) -> Column:
    """Whether two relationships, or lists of them, share none."""
    ids = lambda x: F.transform(x.col, lambda v: v["id"])
    if is_list(r.type) and is_list(other.type):
        return ~F.arrays_overlap(ids(r), ids(other))
    if is_list(other.type):
        return ~F.exists(other.col, lambda v: v["id"] == r.col["id"])
    if is_list(r.type):
        return ~F.exists(r.col, lambda v: v["id"] == other.col["id"])
    return r.col["id"] != other.col["id"]


def is_aggregate(x: Any) -> bool:
    return isinstance(x, A.Call) and x.name in AGGREGATES


def aggregate_column(c: A.Call, args: list[Typed], e: Exprs) -> tuple[Column, T.DataType]:
    name = c.name
    if name == "count":
        if c.star or not args:
            return F.count(F.lit(1)), LONG
        x = args[0]
        if is_null(x.type):
            return F.count(F.lit(None)), LONG
        col = x.col["id"] if is_entity(x.type) else x.col
        return (F.count_distinct(col) if c.distinct else F.count(col)), LONG
    x = args[0]
    if name == "collect":
        inner = STRING if is_null(x.type) else x.type
        col = x.col.cast("string") if is_null(x.type) else x.col
        out = F.collect_list(col)
        if c.distinct:
            out = F.array_distinct(out)
        return out, T.ArrayType(inner)
    if name in ("min", "max"):
        f = F.min if name == "min" else F.max
        return f(x.col), x.type
    share = None
    if name.startswith("percentile"):
        share = c.args[1].value if isinstance(c.args[1], A.Lit) else e.params.get(getattr(c.args[1], "name", ""))
        if not isinstance(share, (int, float)) or not 0 <= share <= 1:
            raise ArgumentError("NumberOutOfRange", f"{name}() takes a share between 0 and 1")
    if is_null(x.type):
        none = F.max(F.lit(None).cast("double"))
        return (F.coalesce(F.max(F.lit(None).cast("long")), F.lit(0).cast("long")), LONG) if name == "sum" else (F.coalesce(none, F.lit(0.0)) if name.startswith("stdev") else none, DOUBLE)
    if not is_num(x.type):
        raise QueryTypeError("InvalidArgumentType", f"{name}() of a {family(x.type)}")
    col = x.col.cast("double") if is_float(x.type) else x.col
    if name == "sum":
        out = F.sum_distinct(col) if c.distinct else F.sum(col)
        return (F.coalesce(out, F.lit(0).cast("long")), LONG) if is_int(x.type) else (F.coalesce(out, F.lit(0.0)), DOUBLE)
    if name == "avg":
        return (F.sum_distinct(col).cast("double") / F.count_distinct(col) if c.distinct else F.avg(col)), DOUBLE
    if name in ("stdev", "stdevp"):
        f = F.stddev_samp if name == "stdev" else F.stddev_pop
        if c.distinct:
            values = F.collect_set(col.cast("double"))
            n = F.size(values)
            mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
            square = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
            return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(square / (n - (1 if name == "stdev" else 0)))), DOUBLE
        return F.coalesce(f(col), F.lit(0.0)), DOUBLE
    if name == "percentilecont":
        return F.percentile(col.cast("double"), F.lit(float(share))), DOUBLE
    ordered = F.sort_array(F.collect_list(col.cast("double")))
    place = F.greatest(F.lit(1), F.ceil(F.size(ordered) * F.lit(float(share)))).cast("int")
    return F.try_element_at(ordered, place), DOUBLE


def empty_value(e: A.Expr, x: Typed) -> Column | None:
    if isinstance(e, A.Call):
        if e.name == "count" or e.name == "sum":
            return F.lit(0).cast(x.type)
        if e.name == "collect":
            return F.array().cast(x.type)
        if e.name in ("stdev", "stdevp"):
            return F.lit(0.0)
    return None


def run(graph: Graph, text: str, params: dict[str, Any]) -> DataFrame:
    """Compile a query over ``graph``; writes happen now, reads when the rows are asked for."""
    from skein.plans.check import check

    query = parse(text)
    check(query)
    before = graph.snapshot()
    compiler = Compiler(graph, params, query)
    state = compiler.query(query)
    writes = any(isinstance(c, A.WRITES) for c in A.walk(query))
    if writes:
        try:
            graph.check_constraints()
        except Exception:
            graph.restore(before)
            raise
        for listener in graph.listeners:
            listener(before, graph)
    df = compiler.rows(state)
    return df.select(*(shown(x).alias(name) for name, x in state.scope.items()))

