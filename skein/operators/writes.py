"""Writing clauses, as whole-table deltas on a graph.

Rows of a writing clause are written to the shared folder first, so that what they create is
numbered once.  New ids follow from the rows' order in those files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import ConstraintError, QuerySyntaxError, QueryTypeError, SemanticError
from skein.functions.typed import LONG, STRING, Typed, family, fields, is_entity, is_list, is_map, is_node, is_null, is_path, is_rel
from skein.plans import ast as A
from skein.sources.storage import materialise


def write(c, state, clause: A.Clause):
    if isinstance(clause, A.Create):
        return create(c, state, clause.patterns)
    if isinstance(clause, A.Merge):
        return merge(c, state, clause)
    if isinstance(clause, A.SetClause):
        return set_items(c, state, clause.items)
    if isinstance(clause, A.Remove):
        return remove_items(c, state, clause.items)
    if isinstance(clause, A.Delete):
        return delete(c, state, clause)
    if isinstance(clause, A.Foreach):
        return foreach(c, state, clause)
    raise QuerySyntaxError("UnexpectedSyntax", type(clause).__name__)


def schema(c, clause: A.Schema):
    from skein.operators.compile import State

    g = c.graph
    if clause.action == "SHOW":
        df = g.show_indexes() if clause.what == "index" else g.show_constraints()
        names = {n: c.fresh(n) for n in df.columns}
        df = df.withColumnsRenamed(names)
        return State(df, {n: Typed(F.col(k), STRING) for n, k in names.items()})
    if clause.what == "index":
        (g.create_node_index if clause.action == "CREATE" else g.drop_node_index)(clause.label, clause.prop)
    elif clause.action == "CREATE":
        g.create_constraint(clause.label, clause.prop, clause.kind)
    else:
        g.drop_constraint(clause.label, clause.prop, clause.kind)
    return State(c.spark.range(0).select(), {})


def settled(c, state):
    """The rows written down, so that later reads see the same ones."""
    from skein.operators.compile import State

    df = c.rows(state)
    if not df.columns:
        df = df.withColumn("__one", F.lit(1))
    return State(materialise(df), dict(state.scope))


def numbered(c, df: DataFrame, kind: str, column: str) -> DataFrame:
    """``df``, rows of files, with fresh ids that are dense in the order of its partitions."""
    sizes = df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    at = c.graph.new_ids(kind, sum(r["n"] for r in sizes))
    shifts: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: r["part"]):
        shifts[r["part"]] = at - (r["part"] << 33)  # where this partition's increasing ids begin
        at += r["n"]
    shift = F.element_at(F.lit([shifts.get(k, 0) for k in range(max(shifts, default=0) + 1)]), F.spark_partition_id() + 1)
    return df.withColumn(column, F.monotonically_increasing_id() + shift)


def struct_node(df: DataFrame, node_id: str, labels: list[str], props: dict[str, Typed]) -> Column:
    p = F.struct(*(x.col.alias(k) for k, x in props.items())) if props else F.struct(F.lit(None).cast("string").alias("_"))
    return F.struct(F.col(node_id).alias("id"), F.array(*(F.lit(x) for x in labels)).cast("array<string>").alias("labels"), p.alias("p"))


def _values(c, state, props: dict[str, A.Expr]) -> dict[str, Typed]:
    e = c.exprs(state)
    out = {}
    for k, v in props.items():
        x = e(v)
        storable(k, x)
        out[k] = Typed(F.lit(None).cast("string"), STRING) if is_null(x.type) else x
    return out


def storable(key: str, x: Typed) -> None:
    t = x.type.elementType if is_list(x.type) else x.type
    if is_entity(t) or is_path(t) or is_map(t) or is_list(t):
        raise QueryTypeError("InvalidPropertyType", f"{key} cannot hold a {family(x.type)}")


def create(c, state, patterns: list[A.Pattern], down: bool = False):
    """``down`` tells that the rows are files already."""
    from skein.operators.compile import State

    for p in patterns:
        c_names = [n.var for n in p.nodes if n.var]
        for n in p.nodes:
            if n.var in state.scope and (n.labels or n.props or len(p.nodes) == 1):
                raise QuerySyntaxError("VariableAlreadyBound", n.var)
        for r in p.rels:
            if r.var and (r.var in state.scope or r.var in c_names):
                raise QuerySyntaxError("VariableAlreadyBound", r.var)
    state = state if down else settled(c, state)
    for p in patterns:
        made: list[Typed] = []
        for n in p.nodes:
            if n.var in state.scope:
                made.append(state.scope[n.var])
                continue
            state, x = new_node(c, state, n)
            made.append(x)
        rels: list[Typed] = []
        for k, r in enumerate(p.rels):
            source, target = (made[k], made[k + 1]) if r.direction != "in" else (made[k + 1], made[k])
            state, x = new_edge(c, state, r, source, target)
            rels.append(x)
        if p.path:
            if p.path in state.scope:
                raise QuerySyntaxError("VariableAlreadyBound", p.path)
            state = c.named_path(state, A.Pattern(p.nodes, p.rels, p.path), made, [(r, None) for r in rels])
    return State(state.df, state.scope)


def new_node(c, state, pat: A.NodePat):
    from skein.operators.compile import State

    key, column = c.fresh("id"), c.fresh(pat.var or "n")
    labels = sorted(set(pat.labels))
    props = _values(c, state, pat.props)
    df = materialise(numbered(c, state.df, "node", key))
    c.graph.put_nodes(tuple(labels), df.select(F.col(key).alias("id"), *(x.col.alias(k) for k, x in props.items())))
    df = df.withColumn(column, struct_node(df, key, labels, props)).drop(key)
    x = c.bind(df, column)
    return State(df, state.scope | ({pat.var: x} if pat.var else {})), x


def new_edge(c, state, pat: A.RelPat, source: Typed, target: Typed):
    from skein.operators.compile import State

    key, column = c.fresh("id"), c.fresh(pat.var or "r")
    props = _values(c, state, pat.props)
    df = materialise(numbered(c, state.df, "edge", key))
    c.graph.put_edges(pat.types[0], df.select(F.col(key).alias("id"), source.col["id"].alias("source"), target.col["id"].alias("target"), *(x.col.alias(k) for k, x in props.items())))
    p = F.struct(*(x.col.alias(k) for k, x in props.items())) if props else F.struct(F.lit(None).cast("string").alias("_"))
    made = F.struct(F.col(key).alias("id"), F.lit(pat.types[0]).alias("type"), source.col["id"].alias("source"), target.col["id"].alias("target"), p.alias("p"))
    df = df.withColumn(column, made).drop(key)
    x = c.bind(df, column)
    return State(df, state.scope | ({pat.var: x} if pat.var else {})), x


def merge(c, state, clause: A.Merge):
    """Match the whole pattern, or create it once for each different combination of what it needs.

    Of rows that would create the same thing the first creates it; the others match what it made,
    as they do where rows run one after another.
    """
    from skein.operators.compile import State

    p = clause.pattern
    state = settled(c, state)
    tests = []
    for x in (*p.nodes, *p.rels):
        for k, v in _values(c, state, x.props).items():
            if isinstance(x.props[k], A.Lit) and x.props[k].value is None:
                raise SemanticError("MergeReadOwnWrites", f"{k} is null")
            if not isinstance(x.props[k], A.Lit):
                tests.append((k, v.col.isNull()))
    if tests:
        bad = state.df.agg(*(F.max(t).alias(f"t{i}") for i, (_, t) in enumerate(tests))).first()
        for i, (k, _) in enumerate(tests):
            if bad[i]:
                raise SemanticError("MergeReadOwnWrites", f"{k} is null")
    used = [v for v in state.scope if v in {x.var for x in (*p.nodes, *p.rels)}]
    keys, inner = c.matched(state, [p], None)
    new = {v: x for v, x in inner.scope.items() if v not in state.scope}
    # Rows that would create the same thing, and which of them comes first.
    exprs = c.exprs(state)
    parts = {c.fresh("m"): x for x in [*(state.scope[v] for v in used), *(exprs(v) for y in (*p.nodes, *p.rels) for v in y.props.values())]}
    parts = {k: Typed(x.col["id"], LONG) if is_entity(x.type) else x for k, x in parts.items() if not is_null(x.type)}
    hit, place = c.fresh("hit"), c.fresh("place")
    found = inner.df.select(*keys.values(), *(x.col for x in new.values()), F.lit(True).alias(hit))
    base = state.df.withColumns({place: F.monotonically_increasing_id(), **{k: x.col for k, x in parts.items()}})
    joined = materialise(base.join(found, c.same(state, keys) if keys else F.lit(True), "left").drop(*keys.values()))
    matched = State(joined.where(F.col(hit)).drop(hit), state.scope | new)
    missing = joined.where(F.col(hit).isNull()).drop(hit, *(c_ for c_ in joined.columns if c_ not in base.columns and c_ != hit))
    first = missing.groupBy(*parts).agg(F.min(place).alias("__first")).select("__first") if parts else missing.agg(F.min(place).alias("__first"))
    makers = materialise(missing.join(first, F.col(place) == F.col("__first")).drop("__first"))
    pattern = A.Pattern(p.nodes, [A.RelPat(r.var, r.types, r.props, "out" if r.direction == "both" else r.direction) for r in p.rels], p.path)
    created = create_merge(c, State(makers, dict(state.scope)), pattern)
    if clause.on_create and not makers.isEmpty():
        created = set_items(c, created, clause.on_create)
    made_new = {v: x for v, x in created.scope.items() if v not in state.scope}
    renamed = {k: c.fresh("k") for k in (*parts, place)}
    right = created.df.select(*(F.col(k).alias(r) for k, r in renamed.items()), *(x.col for x in made_new.values()))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(renamed[k])) for k in parts), F.lit(True))
    others = State(missing.join(right, on & (F.col(place) != F.col(renamed[place]))).drop(*renamed.values()), state.scope | made_new)
    later = joined_rows(c, matched, others)
    if clause.on_match:
        later = settled(c, later)
        if not later.df.isEmpty():
            later = set_items(c, later, clause.on_match)
    return joined_rows(c, later, created)


def create_merge(c, state, p: A.Pattern):
    """Create a pattern some of whose nodes are bound."""
    bare = A.Pattern([A.NodePat(n.var, [], {}) if n.var in state.scope else n for n in p.nodes], p.rels, p.path)
    if len(bare.nodes) == 1 and bare.nodes[0].var in state.scope:
        return state
    return create(c, state, [bare], down=True)


def joined_rows(c, a, b):
    from skein.functions.typed import common, fit
    from skein.operators.compile import State

    scope, left, right = {}, [], []
    for v, x in a.scope.items():
        y = b.scope[v]
        t = common(x.type, y.type) or STRING
        column = c.fresh(v)
        left.append(fit(x, t).alias(column))
        right.append(fit(y, t).alias(column))
        scope[v] = Typed(F.col(column), t)
    one = F.lit(1).alias("__one")
    return State(a.df.select(one, *left).unionAll(b.df.select(one, *right)), scope)


def target(c, state, e: A.Expr) -> Typed:
    x = c.exprs(state)(e)
    if not (is_entity(x.type) or is_null(x.type)):
        raise QueryTypeError("InvalidArgumentType", f"a {family(x.type)} has no properties to write")
    return x


def set_items(c, state, items: list[A.SetItem]):
    """Apply assignments one after another; later ones see earlier ones."""
    state = settled(c, state)
    for item in items:
        x = target(c, state, item.target)
        if is_null(x.type):
            continue
        state, ready = c.prepare(state, item.value)
        live = state.df.where(x.col.isNotNull())
        g = c.graph
        if item.kind == "labels":
            if not is_node(x.type):
                raise QueryTypeError("InvalidArgumentType", "labels belong to nodes")
            g.change_labels(materialise(live.select(x.col["id"].alias("id")).distinct()), item.labels, [])
            state = relabelled(c, state, item.target, x, item.labels, [])
            continue
        value = c.exprs(state, ready)(item.value)
        if item.kind == "prop":
            storable(item.key, value)
            values = {item.key: value}
            whole = False
        else:
            if is_entity(value.type):
                value = value.get("p")
            if not is_map(value.type):
                raise QueryTypeError("InvalidArgumentType", "a map is needed")
            values = {n: value.get(n) for n in fields(value.type) if n not in ("_", "_empty")}
            whole = item.kind == "replace"
            for n, v in values.items():
                storable(n, v)
        delta = live.select(x.col["id"].alias("id"), *((F.lit(None).cast("string") if is_null(v.type) else v.col).alias(f"x_{n}") for n, v in values.items()))
        delta = materialise(delta)
        change = g.change_nodes if is_node(x.type) else g.change_edges
        change(delta, {n: F.col(f"`x_{n}`") for n in values}, whole)
        state = updated(c, state, item.target, x, values, whole)
    return settled(c, state)


def updated(c, state, e: A.Expr, x: Typed, values: dict[str, Typed], whole: bool):
    """The variable with its new properties."""
    from skein.operators.compile import State

    if not isinstance(e, A.Var):
        return state
    p = x.get("p")
    old = {} if whole else {n: p.get(n) for n in fields(p.type) if n != "_"}
    new = old | {n: (Typed(F.lit(None).cast("string"), STRING) if is_null(v.type) else v) for n, v in values.items()}
    props = F.struct(*(v.col.alias(n) for n, v in new.items())) if new else F.struct(F.lit(None).cast("string").alias("_"))
    column = c.fresh(e.name)
    rest = [x.col[n].alias(n) for n in fields(x.type) if n != "p"]
    df = state.df.withColumn(column, F.when(x.col.isNotNull(), F.struct(*rest, props.alias("p"))))
    return State(df, state.scope | {e.name: c.bind(df, column)})


def relabelled(c, state, e: A.Expr, x: Typed, add: list[str], drop: list[str]):
    from skein.operators.compile import State

    if not isinstance(e, A.Var):
        return state
    array = lambda names: F.array(*(F.lit(n) for n in names)).cast("array<string>")
    labels = F.array_union(F.array_except(x.col["labels"], array(drop)), array(add))
    column = c.fresh(e.name)
    df = state.df.withColumn(column, F.when(x.col.isNotNull(), F.struct(x.col["id"].alias("id"), labels.alias("labels"), x.col["p"].alias("p"))))
    return State(df, state.scope | {e.name: c.bind(df, column)})


def remove_items(c, state, items: list[A.SetItem]):
    state = settled(c, state)
    for item in items:
        x = target(c, state, item.target)
        if is_null(x.type):
            continue
        ids = materialise(state.df.where(x.col.isNotNull()).select(x.col["id"].alias("id")).distinct())
        if item.kind == "labels":
            c.graph.change_labels(ids, [], item.labels)
            state = relabelled(c, state, item.target, x, [], item.labels)
        else:
            (c.graph.change_nodes if is_node(x.type) else c.graph.change_edges)(ids, {item.key: F.lit(None).cast("string")})
            state = updated(c, state, item.target, x, {item.key: Typed(F.lit(None), T.NullType())}, False)
    return state


def delete(c, state, clause: A.Delete):
    state = settled(c, state)
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    for e in clause.of:
        x = c.exprs(state)(e)
        if is_null(x.type):
            continue
        if is_path(x.type):
            nodes.append(state.df.select(F.explode(x.col["nodes"]).alias("e")).select(F.col("e.id").alias("id")))
            edges.append(state.df.select(F.explode(x.col["rels"]).alias("e")).select(F.col("e.id").alias("id")))
        elif is_node(x.type):
            nodes.append(state.df.where(x.col.isNotNull()).select(x.col["id"].alias("id")))
        elif is_rel(x.type):
            edges.append(state.df.where(x.col.isNotNull()).select(x.col["id"].alias("id")))
        elif is_list(x.type) and is_entity(x.type.elementType):
            (nodes if is_node(x.type.elementType) else edges).append(state.df.select(F.explode(x.col).alias("e")).select(F.col("e.id").alias("id")))
        else:
            raise QueryTypeError("InvalidArgumentType", f"a {family(x.type)} cannot be deleted")
    if edges:
        c.graph.drop_edges(materialise(reduce(DataFrame.unionAll, edges).distinct()))
    if nodes:
        gone = materialise(reduce(DataFrame.unionAll, nodes).distinct())
        if not clause.detach:
            for t in c.graph.edges.values():
                for end in ("source", "target"):
                    if not t.df.join(gone.select(F.col("id").alias("__g")), F.col(end) == F.col("__g"), "left_semi").isEmpty():
                        raise ConstraintError("DeleteConnectedNode", "a node still has relationships")
        c.graph.drop_nodes(gone)
    return state


def foreach(c, state, clause: A.Foreach):
    """The body runs over all elements of all rows at once; it sees outer variables too."""
    if clause.var in state.scope:
        raise QuerySyntaxError("VariableAlreadyBound", clause.var)
    state = settled(c, state)
    inner = c.unwind(state, A.Unwind(clause.of, clause.var))
    for part in clause.body:
        inner = write(c, inner, part)
    return state

