"""Shortest paths by growing a frontier of (source, node) pairs.

A frontier row holds ids only: its source, where it is, and the relationships that led there.
Each step is one job that writes what it newly reached; what was reached before, and which pairs
are found, is read from the files of the former steps.  Nodes and properties are joined once, for
the paths that were found, and only where the query looks at them.

Where a pattern itself pairs many ends, only ends of one connected component are paired, and
components whose nodes are all linked need no search: their edges are the paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import ArgumentError, QuerySyntaxError
from skein.functions.exprs import Exprs
from skein.functions.typed import Typed, equal
from skein.plans import ast as A
from skein.sources.storage import materialise, paired, written

#: Hops in one job while a frontier has at most so many rows and does not grow.
CALM_HOPS, CALM_ROWS = 4, 10_000
#: Sources from which components are found before ends are paired; a search from fewer costs less.
SOURCES = 64
#: Nodes, as rows of four longs at most, that are broadcast by hand: some 16 MB.
NODES = 200_000
_PLAIN = (A.Bin, A.Un, A.Lit, A.Param, A.Var, A.Prop, A.IsNull, A.HasLabels)
_COMPARE = {"AND", "OR", "=", "<>", "<", "<=", ">", ">="}
_STEP = "src long, cur long, ids array<long>, hit boolean"


def shortest(c, state, p: A.Pattern, where: A.Expr | None = None):
    """Bind the path and its ends: one path per pair of ends, or all of the least length."""
    from skein.operators.compile import MAX_HOPS, State

    if len(p.rels) != 1:
        raise QuerySyntaxError("InvalidShortestPath", "a shortest path takes one relationship pattern")
    rel, (a, b) = p.rels[0], p.nodes
    if a.var is None or b.var is None:
        raise QuerySyntaxError("InvalidShortestPath", "both ends need a variable")
    low, high = rel.span or (1, 1)
    sides = _sides(c, state, a, b)
    for pat in (a, b):
        state, _ = c.node(state, pat) if pat.var not in state.scope else (c.restrict(state, state.scope[pat.var], pat), None)
    tables = c.graph.edge_tables(rel.types)
    path = p.path or c.fresh("path")
    wants = c.path_wants(p.path)
    inside = wants is not None and wants.nodes
    rel_props = c.wants(rel.var, rel.props) if rel.var else set()
    rel_props = rel_props if wants is None or rel_props is None else None if wants.rel_props is None else rel_props | wants.rel_props
    rel_type = c.rel_type(tables, rel_props)
    over = c.shared_labels([e for t in tables for e in (t.source, t.target)])
    nodes = c.graph.node_scan(over, wants.node_props if inside else set(), "n") if tables else None
    node_type = (nodes if nodes is not None else c.nothing("n")).schema["n"].dataType
    if not tables or nodes is None:
        return State(c.rows(state).limit(0).withColumn(path, F.lit(None).cast(T.StructType([T.StructField("nodes", T.ArrayType(node_type)), T.StructField("rels", T.ArrayType(rel_type))]))), state.scope)

    def links(direction: str) -> DataFrame:
        edges = c.graph.edge_scan(tables, set(rel.props), direction, "e_")
        if rel.props:
            r = Typed(F.col("e_rel"), edges.schema["e_rel"].dataType)
            for key, value in rel.props.items():
                edges = edges.where(equal(Exprs({}, c.params).property(r, key), Exprs({}, c.params)(value)))
        return edges.select("e_near", "e_far", F.col("e_rel.id").alias("e_id"))

    one = p.shortest == "one"
    many = sides is not None and sides[a.var].df.limit(SOURCES).count() == SOURCES
    if many:
        state = State(None, sides[a.var].scope | sides[b.var].scope)
        found = _between(c, sides[a.var], sides[b.var], state.scope[a.var], state.scope[b.var], state.scope, where, links, rel.direction, low, high, one)
    else:
        state = State(_kept(c, state.df, state.scope, where), state.scope)
        wanted = materialise(state.df.select(state.scope[a.var].col["id"].alias("src"), state.scope[b.var].col["id"].alias("dst")).distinct())
        found = _grow(c.spark, wanted, materialise(links(rel.direction)), low, high, one, MAX_HOPS)
    left, right = state.scope[a.var], state.scope[b.var]

    def ends(made: DataFrame) -> DataFrame:
        """The rows of both ends beside what was made for them."""
        one_end, other = left.col["id"] == F.col("__src"), right.col["id"] == F.col("__dst")
        return made.join(sides[a.var].df, one_end).join(sides[b.var].df, other) if many else state.df.join(made, one_end & other)

    # A path's relationships in order, and the nodes that they pass.
    every = c.graph.edge_scan(tables, rel_props, "out", "").select("rel")
    looked = bool(rel_props) or rel_props is None or inside or rel.var is not None
    column = c.fresh(path)
    single = "e_id" in found.columns  # paths of one relationship each
    if looked:
        found = found.select("src", "dst", F.array("e_id").alias("ids")) if single else found
        keyed = found.select(F.monotonically_increasing_id().alias("k"), "src", "dst", "ids")
        keyed = materialise(keyed)
        parts = keyed.select("k", F.posexplode("ids").alias("at", "e")).join(every, F.col("e") == F.col("rel.id")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "rel"))).alias("rs"))
        rels = F.transform(F.coalesce("rs", F.array().cast(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("rel", rel_type)])))), lambda x: x["rel"])
        paths = keyed.join(parts.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), "left").select("k", "src", "dst", rels.alias("rels"))
        if inside:
            seen = F.aggregate("rels", F.array("src"), lambda s, x: F.concat(s, F.array(F.when(F.element_at(s, -1) == x["source"], x["target"]).otherwise(x["source"]))))
            paths = paths.withColumn("ids", seen)
            passed = paths.select("k", F.posexplode("ids").alias("at", "e")).join(nodes, F.col("e") == F.col("n.id")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("ns"))
            paths = paths.join(passed.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).withColumn("nodes", F.transform("ns", lambda x: x["n"]))
        if not inside:
            paths = paths.withColumn("nodes", F.array().cast(T.ArrayType(node_type)))
        df = ends(paths.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.struct("nodes", "rels").alias(column))).drop("__src", "__dst")
    else:
        bare = lambda x: F.struct(*(x.alias("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in rel_type.fields))
        ids = c.fresh("ids")
        rels = F.array(bare(F.col(ids))) if single else F.transform(ids, bare)
        df = ends(found.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("e_id" if single else "ids").alias(ids)))
        df = df.withColumn(column, F.struct(F.array().cast(T.ArrayType(node_type)).alias("nodes"), rels.alias("rels"))).drop("__src", "__dst", ids)
    scope = dict(state.scope)
    if p.path:
        scope[p.path] = c.bind(df, column)
    if rel.var:
        scope[rel.var] = scope[p.path].get("rels") if p.path else c.bind(df, column).get("rels")
    return State(df, scope)


def _sides(c, state, a: A.NodePat, b: A.NodePat):
    """By variable, the rows so far with one end, and the nodes of the other, where the pattern itself pairs them; else None."""
    from skein.operators.compile import State

    fresh = [x for x in (a, b) if x.var not in state.scope]
    if not fresh or a.var == b.var or any(isinstance(x, A.Var) for x in A.walk(fresh[-1].props)):
        return None
    last = fresh[-1]
    first = a if last is b else b
    state = c.restrict(state, state.scope[first.var], first) if first.var in state.scope else c.node(state, first)[0]
    return {first.var: state, last.var: c.node(State(None, {}), last)[0]}


def _kept(c, df: DataFrame, scope: dict[str, Typed], where: A.Expr | None) -> DataFrame:
    """Rows that pass the comparisons of ``where`` on bound variables alone; it holds again, as a whole, once paths are bound."""
    from skein.operators.compile import conjuncts

    for part in conjuncts(where) if where is not None else []:
        parts = list(A.walk(part))
        if all(isinstance(x, _PLAIN) and (not isinstance(x, A.Bin) or x.op in _COMPARE) and (not isinstance(x, A.Var) or x.name in scope) for x in parts):
            df = df.where(Exprs(scope, c.params).predicate(part))
    return df


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows of up to four longs, to be broadcast if they are few."""
    return F.broadcast(df) if rows <= NODES else df


def _between(c, a_side, b_side, left: Typed, right: Typed, scope: dict[str, Typed], where: A.Expr | None, links, direction: str, low: int, high: int | None, one: bool) -> DataFrame:
    """Paths between the ends of two sides: (src, dst, e_id) where all have one relationship, else (src, dst, ids)."""
    from skein.operators.compile import MAX_HOPS

    both = direction == "both"
    once, size = _counted(links("out" if both else direction))
    nodes, count = _linked(once, both)
    kinds = {r["whole"] for r in nodes.select("whole").distinct().collect()}
    if one and False in kinds:  # of parallel relationships the first stands for all
        ends = (F.least("e_near", "e_far"), F.greatest("e_near", "e_far")) if both else (F.col("e_near"), F.col("e_far"))
        single, left_over = _counted(once.select(ends[0].alias("e_near"), ends[1].alias("e_far"), "e_id").groupBy("e_near", "e_far").agg(F.min("e_id").alias("e_id")))
        if left_over < size:
            once = single
            nodes, count = _linked(once, both)
            kinds = {r["whole"] for r in nodes.select("whole").distinct().collect()}
    edges = once.unionAll(once.where("e_near <> e_far").select(F.col("e_far").alias("e_near"), F.col("e_near").alias("e_far"), "e_id")) if both else once

    # To be searched: ends in components with nodes that are not linked, and nodes that are both ends.
    def placed(df: DataFrame, end: Typed, name: str) -> DataFrame:
        df = df.withColumn(name, end.col["id"])
        at = _small(nodes, count).select(F.col("id").alias("__id"), F.col("root").alias("__root"), F.col("whole").alias("__whole"))
        return df.join(at, F.col(name) == F.col("__id"), "left").withColumn("__root", F.coalesce("__root", name)).withColumn("__whole", F.coalesce("__whole", F.lit(True))).drop("__id")

    starts, ends = placed(a_side.df, left, "__src"), placed(b_side.df, right, "__dst")
    some = lambda df, whole: df.where(F.col("__whole") == whole).drop("__whole")
    apart = paired(some(starts, False), some(ends, False), "__root", "__src")
    same = some(starts, True).drop("__root").join(some(ends, True).drop("__root"), F.col("__src") == F.col("__dst"))
    pairs = [_kept(c, df, scope, where).select(F.col("__src").alias("src"), F.col("__dst").alias("dst")) for df in ([same, apart] if False in kinds else [same])]
    wanted = materialise((pairs[0].unionAll(pairs[1]) if len(pairs) > 1 else pairs[0]).distinct())
    direct = edges.where("e_near <> e_far")
    if kinds - {True}:
        direct = direct.join(_small(nodes.where("whole").select("id"), count), F.col("e_near") == F.col("id"), "left_semi")
    direct = direct.select(F.col("e_near").alias("src"), F.col("e_far").alias("dst"), "e_id")
    if wanted.isEmpty():
        return direct
    found = _grow(c.spark, wanted, edges, low, high, one, MAX_HOPS).select("src", "dst", "ids")
    return found.unionAll(direct.select("src", "dst", F.array("e_id").alias("ids"))) if True in kinds else found


def _linked(edges: DataFrame, both: bool) -> tuple[DataFrame, int]:
    """(id, root, whole): every node with an edge to another, its component's smallest node, whether each node there has
    one edge to each other; and how many nodes there are.

    It is whole where each node has as many edges as there are others, and their ends with itself are the
    component, by 128 bits.  So no two edges are parallel.
    """
    nodes, count = _components(edges, both)
    marks = [F.count(F.lit(1)).alias("n"), F.min("linked").alias("least"), F.max("linked").alias("most")]
    whole = (F.col("n") - 1 == F.col("least")) & (F.col("n") - 1 == F.col("most"))
    for k, h in enumerate(_hashes("id")):
        ends = F.col(f"ends{k}").bitwiseXOR(h)
        marks += [F.bit_xor(h).alias(f"all{k}"), F.min(ends).alias(f"least{k}"), F.max(ends).alias(f"most{k}")]
        whole = whole & (F.col(f"all{k}") == F.col(f"least{k}")) & (F.col(f"all{k}") == F.col(f"most{k}"))
    sizes = nodes.groupBy("root").agg(*marks).select("root", F.coalesce(whole, F.lit(False)).alias("whole"))
    return materialise(nodes.join(sizes, "root").select("id", "root", "whole")), count


def _hashes(name: str) -> list:
    return [F.xxhash64(name), F.xxhash64(F.lit(1), name)]


def _components(edges: DataFrame, both: bool) -> tuple[DataFrame, int]:
    """(id, root, linked, ends0, ends1): every node with an edge to another, the smallest node of its component, the number
    of edges that leave it, the hashes of their ends; and how many nodes there are.

    Nodes point to their smallest neighbour and then to where that points, until nothing moves; what
    is left between components is contracted to edges of their roots.
    """
    links, whole, number = edges.where("e_near <> e_far").select(F.col("e_near").alias("a"), F.col("e_far").alias("b")), None, 0
    while True:
        ways = links.select("a", "b", F.lit(True).alias("out")).unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(both).alias("out")))
        more = [F.count_if("out").alias("linked"), *(F.bit_xor(F.when(F.col("out"), h)).alias(f"ends{k}") for k, h in enumerate(_hashes("b")))] if whole is None else []
        up, count = _counted(ways.groupBy("a").agg(F.min("b").alias("m"), *more).withColumn("up", F.least("a", "m")).drop("m"))
        moved = count
        while moved:
            higher = _small(up.select(F.col("a").alias("x"), F.col("up").alias("y")), count)
            told = Observation()
            step = up.join(higher, F.col("up") == F.col("x")).withColumn("moved", F.col("y") != F.col("up")).observe(told, F.count_if("moved").alias("n"))
            path = written(step.withColumn("up", F.col("y")).select(*up.columns))
            up, moved = links.sparkSession.read.schema(up.schema).parquet(path), told.get["n"]
        at = _small(up.select(F.col("a").alias("x"), F.col("up").alias("y")), count)
        if whole is None:
            whole, number = up.withColumnsRenamed({"a": "id", "up": "root"}), count
        else:
            whole = materialise(whole.join(at, F.col("root") == F.col("x"), "left").withColumn("root", F.coalesce("y", "root")).drop("x", "y"))
        near, far = at.select(F.col("x").alias("a"), F.col("y").alias("ra")), at.select(F.col("x").alias("b"), F.col("y").alias("rb"))
        links, left = _counted(links.join(near, "a").join(far, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if not left:
            return whole, number


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written, and its number of rows."""
    told = Observation()
    path = written(df.observe(told, F.count(F.lit(1)).alias("n")))
    return df.sparkSession.read.schema(df.schema).parquet(path), told.get["n"]


def _grow(spark, wanted: DataFrame, edges: DataFrame, low: int, high: int | None, one: bool, most: int) -> DataFrame:
    """(src, dst, ids): the relationships of one shortest path for each pair, or of all of them."""
    read = lambda paths: spark.read.schema(_STEP).parquet(*paths)
    start = wanted.groupBy("src").agg(F.max((F.col("src") == F.col("dst")) & (low == 0)).alias("hit")).select("src", F.col("src").alias("cur"), F.array().cast("array<long>").alias("ids"), "hit")
    steps = [written(start)]
    total = wanted.count()
    pairs = wanted.groupBy("src").agg(F.count(F.lit(1)).alias("pairs")).withColumnRenamed("src", "s3")
    ends = wanted.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), F.lit(True).alias("end"))
    done = read(steps).where("hit").count() if low == 0 else 0
    depth, size, calm, bound = 0, total, False, min(high or most, most)

    def hop(front: DataFrame) -> DataFrame:
        step = front.join(edges, F.col("cur") == F.col("e_near")).select("src", F.col("e_far").alias("cur"), F.concat("ids", F.array("e_id")).alias("ids"))
        return step.groupBy("src", "cur").agg(F.min("ids").alias("ids")) if one else step

    while done < total:
        if depth >= bound:
            if high is None or high > most:  # pairs are open and may lie further apart
                raise ArgumentError("PathTooLong", f"paths of more than {most} relationships")
            break
        front = read(steps[-1:]).where(F.size("ids") == depth)
        if done:  # sources that have found all their ends rest
            full = read(steps).where("hit").select("src", "cur").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(pairs, F.col("src") == F.col("s3")).where("n = pairs").select(F.col("src").alias("s4"))
            front = front.join(full, F.col("src") == F.col("s4"), "left_anti")
        # A small frontier that does not grow takes several hops in one job.
        hops = min(CALM_HOPS if one and calm else 1, bound - depth)
        layers = [hop(front)]
        for _ in range(hops - 1):
            layers.append(hop(layers[-1]))
        step = layers[0]
        for layer in layers[1:]:
            step = step.unionAll(layer)
        if hops > 1:
            step = step.groupBy("src", "cur").agg(F.min(F.struct(F.size("ids").alias("n"), F.col("ids"))).alias("least")).select("src", "cur", F.col("least.ids").alias("ids"))
        # A circle back to its source is a path as well, the first time it closes.
        before = read(steps).where(F.size("ids") > 0).select(F.col("src").alias("s1"), F.col("cur").alias("c1"))
        step = step.join(before, (F.col("src") == F.col("s1")) & (F.col("cur") == F.col("c1")), "left_anti")
        if low == 0:
            step = step.where("src <> cur")
        step = step.join(ends, (F.col("src") == F.col("s2")) & (F.col("cur") == F.col("d2")), "left").select("src", "cur", "ids", F.coalesce("end", F.lit(False)).alias("hit"))
        told = Observation()
        steps.append(written(step.observe(told, F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))))
        found = told.get
        depth += hops
        if not found["n"]:
            break
        calm, size = found["n"] <= min(CALM_ROWS, 2 * size * hops), max(1, found["n"] // hops)
        done = done + found["hits"] if one else read(steps).where("hit").select("src", "cur").distinct().count()
    return read(steps).where("hit").select("src", F.col("cur").alias("dst"), "ids")
