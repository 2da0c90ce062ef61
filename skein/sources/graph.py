"""Property graphs as typed tables: one per label set, one per relationship type.

A node table has ``id`` and one column per property, and ``labels`` where its nodes differ in
them; an edge table has ``id``, ``source``, ``target`` and properties.  Ids are global: an
ordinal per table in the upper bits, the table's own key in the lower ones, so they are
deterministic and need no numbering pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import ArgumentError, ConstraintError
from skein.functions.typed import STRING, common, fit, Typed
from skein.sources.storage import materialise

ORDINAL_BITS = 48
SYSTEM = {"id", "labels", "source", "target"}
#: Appends to a table after which it is written down.
APPENDS = 16


@dataclass(frozen=True)
class NodeTable:
    """``labels`` are on every node; ``dynamic`` ones on some, told by the column ``labels``."""

    df: DataFrame
    labels: tuple[str, ...]
    dynamic: frozenset[str] = frozenset()

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in ("id", "labels")}

    def label_column(self) -> Column:
        return F.col("labels") if "labels" in self.df.columns else F.array(*(F.lit(x) for x in self.labels)).cast("array<string>")

    def may_have(self, labels: Iterable[str]) -> bool:
        return set(labels) <= set(self.labels) | self.dynamic


@dataclass(frozen=True)
class EdgeTable:
    """``source`` and ``target`` are the labels of all its ends, or None where they vary."""

    type: str
    df: DataFrame
    source: tuple[str, ...] | None = None
    target: tuple[str, ...] | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in ("id", "source", "target")}


def _plain(c: Column, t: T.DataType) -> tuple[Column, T.DataType]:
    """A stored column in one of the language's types."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long"), T.LongType()
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return c.cast("double"), T.DoubleType()
    return c, t


def _props_struct(df: DataFrame, props: dict[str, T.DataType], wanted: dict[str, T.DataType]) -> Column:
    if not wanted:
        return F.struct(F.lit(None).cast("string").alias("_"))
    return F.struct(*(fit(Typed(F.col(f"`{n}`"), props[n]), t).alias(n) if n in props else F.lit(None).cast(t).alias(n) for n, t in wanted.items()))


def _merged(tables: Iterable[dict[str, T.DataType]], wanted: set[str] | None) -> dict[str, T.DataType]:
    out: dict[str, T.DataType] = {}
    for props in tables:
        for n, t in props.items():
            if wanted is None or n in wanted:
                both = common(out[n], t) if n in out else t
                out[n] = both if both is not None else STRING
    return out


class Graph:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.nodes: dict[str, NodeTable] = {}
        self.edges: dict[str, EdgeTable] = {}
        self.ordinals: dict[str, int] = {}
        self.next_id = {"node": 1, "edge": 1}
        self.indexes: set[tuple[str, str]] = set()
        self.constraints: set[tuple[str, str, str]] = set()
        self.procedures: dict[str, Any] = {}
        self.listeners: list[Any] = []
        #: What writers touched, in order: (node or edge, ids, type of the edges); (all, None, None) where that is not known.
        self.touched: list[tuple[str, DataFrame | None, str | None]] = []
        self.appended: dict[str, int] = {}

    # --- loading

    def ordinal(self, name: str) -> int:
        return self.ordinals.setdefault(name, len(self.ordinals) + 1)

    def global_id(self, name: str, key: Column) -> Column:
        return F.lit(self.ordinal(name) << ORDINAL_BITS) + key.cast("long")

    def add_nodes(self, label: str, df: DataFrame, key: str, props: dict[str, str], labels: tuple[str, ...] | None = None) -> Graph:
        """Nodes of one label from a table; ``props`` maps property names to columns."""
        types = {f.name: f.dataType for f in df.schema}
        columns = [_plain(F.col(c), types[c])[0].alias(n) for n, c in props.items()]
        self.touched.append(("all", None, None))
        self.nodes[label] = NodeTable(df.select(self.global_id(f"node:{label}", F.col(key)).alias("id"), *columns), labels or (label,))
        return self

    def add_edges(self, name: str, df: DataFrame, key: Column, source: tuple[str, str], target: tuple[str, str], props: dict[str, str] | None = None, type: str | None = None) -> Graph:
        """Relationships from a table with the keys of both ends; ``source`` and ``target`` are (label, column)."""
        types = {f.name: f.dataType for f in df.schema}
        columns = [_plain(F.col(c), types[c])[0].alias(n) for n, c in (props or {}).items()]
        made = df.select(
            self.global_id(f"edge:{name}", key).alias("id"), self.global_id(f"node:{source[0]}", F.col(source[1])).alias("source"), self.global_id(f"node:{target[0]}", F.col(target[1])).alias("target"), *columns
        )
        self.touched.append(("all", None, None))
        self.edges[name] = EdgeTable(type or name, made, self.nodes[source[0]].labels, self.nodes[target[0]].labels)
        return self

    @classmethod
    def from_frames(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph from canonical tables: (node_id, labels, ...) and (rel_id, rel_type, source_node_id, target_node_id, ...)."""
        g = cls(spark)
        named = nodes.withColumnRenamed("node_id", "id")
        found = {x for r in named.select(F.explode("labels").alias("l")).distinct().collect() for x in r}  # the label registry
        g.nodes["*"] = NodeTable(named.select("id", "labels", *(c for c in named.columns if c not in SYSTEM)), (), frozenset(found))
        renamed = edges.withColumnsRenamed({"rel_id": "id", "source_node_id": "source", "target_node_id": "target"})
        for r in renamed.select("rel_type").distinct().collect():  # the type registry
            part = renamed.where(F.col("rel_type") == r["rel_type"]).select("id", "source", "target", *(c for c in renamed.columns if c not in SYSTEM and c != "rel_type"))
            g.edges[r["rel_type"]] = EdgeTable(r["rel_type"], part)
        top = lambda df: (df.agg(F.max("id")).first()[0] or 0) + 1
        g.next_id = {"node": top(named), "edge": top(renamed)}
        return g

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """A graph saved by :meth:`save`."""
        meta = json.loads(spark.read.text(f"{path}/catalog").first()[0])
        g = cls(spark)
        for name, m in meta["nodes"].items():
            g.nodes[name] = NodeTable(spark.read.parquet(f"{path}/nodes/{m['dir']}"), tuple(m["labels"]), frozenset(m["dynamic"]))
        for name, m in meta["edges"].items():
            ends = [tuple(x) if x is not None else None for x in (m["source"], m["target"])]
            g.edges[name] = EdgeTable(m["type"], spark.read.parquet(f"{path}/edges/{m['dir']}"), *ends)
        g.ordinals, g.next_id = meta["ordinals"], meta["next_id"]
        g.indexes, g.constraints = {tuple(x) for x in meta["indexes"]}, {tuple(x) for x in meta["constraints"]}
        return g

    def save(self, path: str) -> None:
        """Write all tables as Parquet, and the catalog last."""
        meta: dict[str, Any] = {"nodes": {}, "edges": {}, "ordinals": self.ordinals, "next_id": self.next_id, "indexes": sorted(self.indexes), "constraints": sorted(self.constraints)}
        for k, (name, t) in enumerate(self.nodes.items()):
            t.df.write.mode("overwrite").parquet(f"{path}/nodes/{k}")
            meta["nodes"][name] = {"dir": str(k), "labels": list(t.labels), "dynamic": sorted(t.dynamic)}
        for k, (name, e) in enumerate(self.edges.items()):
            e.df.write.mode("overwrite").parquet(f"{path}/edges/{k}")
            meta["edges"][name] = {"dir": str(k), "type": e.type, "source": e.source, "target": e.target}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")

    # --- scans

    def node_scan(self, labels: list[str], props: set[str] | None, name: str) -> DataFrame | None:
        """Nodes with all ``labels`` as one struct column; None if no table can hold any."""
        tables = [t for t in self.nodes.values() if t.may_have(labels)]
        if not tables:
            return None
        wanted = _merged((t.props for t in tables), props)
        parts = []
        for t in tables:
            df = t.df
            for label in labels:
                if label not in t.labels:
                    df = df.where(F.array_contains("labels", label))
            parts.append(df.select(F.struct(F.col("id"), t.label_column().alias("labels"), _props_struct(df, t.props, wanted).alias("p")).alias(name)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def edge_tables(self, types: list[str]) -> list[EdgeTable]:
        return [e for e in self.edges.values() if not types or e.type in types]

    def edge_scan(self, tables: list[EdgeTable], props: set[str] | None, direction: str, prefix: str) -> DataFrame:
        """Edges seen from one end: ``<prefix>near``, ``far``, their labels, and the struct ``rel``."""
        wanted = _merged((e.props for e in tables), props)
        parts = []
        for e in tables:
            rel = F.struct(F.col("id"), F.lit(e.type).alias("type"), F.col("source"), F.col("target"), _props_struct(e.df, e.props, wanted).alias("p")).alias(f"{prefix}rel")
            label = lambda x: (F.array(*(F.lit(v) for v in x)) if x is not None else F.lit(None)).cast("array<string>")
            out = (F.col("source").alias(f"{prefix}near"), F.col("target").alias(f"{prefix}far"), label(e.source).alias(f"{prefix}near_labels"), label(e.target).alias(f"{prefix}far_labels"), rel)
            back = (F.col("target").alias(f"{prefix}near"), F.col("source").alias(f"{prefix}far"), label(e.target).alias(f"{prefix}near_labels"), label(e.source).alias(f"{prefix}far_labels"), rel)
            if direction in ("out", "both"):
                parts.append(e.df.select(*out))
            if direction == "in":
                parts.append(e.df.select(*back))
            if direction == "both":  # a self-loop is one step
                parts.append(e.df.where("source <> target").select(*back))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionAll(p)
        return whole

    # --- catalog

    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes.values() for x in (*t.labels, *t.dynamic)})

    def relationship_types(self) -> list[str]:
        return sorted({e.type for e in self.edges.values()})

    def property_keys(self) -> list[str]:
        return sorted({p for t in (*self.nodes.values(), *self.edges.values()) for p in t.props})

    def schema_info(self) -> dict[str, Any]:
        return {"labels": self.labels(), "relationship_types": self.relationship_types(), "property_keys": self.property_keys(), "nodes": self.count_nodes(), "edges": self.count_edges()}

    def am_stats(self) -> DataFrame:
        """Rows per table."""
        rows = [("node", n, t.df) for n, t in self.nodes.items()] + [("edge", n, e.df) for n, e in self.edges.items()]
        out = None
        for kind, name, df in rows:
            one = df.agg(F.count(F.lit(1)).alias("live_rows")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "live_rows")
            out = one if out is None else out.unionAll(one)
        return out if out is not None else self.spark.createDataFrame([], "kind string, name string, live_rows long")

    def health_check(self) -> dict[str, Any]:
        """Whether every edge has both its ends."""
        nodes, bad = self.all_nodes("n"), 0
        for e in self.edges.values():
            for end in ("source", "target"):
                bad += 0 if nodes is None else e.df.join(nodes, F.col(end) == F.col("n.id"), "left_anti").count()
        return {"ok": bad == 0, "dangling_ends": bad}

    def all_nodes(self, name: str, props: set[str] | None = None) -> DataFrame | None:
        return self.node_scan([], props, name)

    # --- relational access

    def nodes_table(self) -> DataFrame:
        """(node_id, labels, properties) of all nodes, properties as JSON."""
        nodes = self.all_nodes("n")
        if nodes is None:
            return self.spark.createDataFrame([], "node_id long, labels array<string>, properties string")
        return nodes.select(F.col("n.id").alias("node_id"), F.col("n.labels").alias("labels"), _json(nodes.schema["n"].dataType["p"].dataType, "n.p").alias("properties"))

    def edges_table(self) -> DataFrame:
        """(rel_id, rel_type, source_node_id, target_node_id, properties) of all relationships."""
        if not self.edges:
            return self.spark.createDataFrame([], "rel_id long, rel_type string, source_node_id long, target_node_id long, properties string")
        e = self.edge_scan(list(self.edges.values()), None, "out", "")
        return e.select(F.col("rel.id").alias("rel_id"), F.col("rel.type").alias("rel_type"), F.col("near").alias("source_node_id"), F.col("far").alias("target_node_id"), _json(e.schema["rel"].dataType["p"].dataType, "rel.p").alias("properties"))

    def register(self, prefix: str = "") -> None:
        """The temporary views ``nodes`` and ``edges`` for SQL, as the graph is now."""
        self.nodes_table().createOrReplaceTempView(f"{prefix}nodes")
        self.edges_table().createOrReplaceTempView(f"{prefix}edges")

    def query_json(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows of a query as JSON objects in one column ``row``; nulls are written."""
        df = self.query(text, params)
        return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("row") if df.columns else F.lit("{}").alias("row"))

    # --- reading by id and filter

    def count_nodes(self) -> int:
        return sum(t.df.count() for t in self.nodes.values())

    def count_edges(self) -> int:
        return sum(e.df.count() for e in self.edges.values())

    def get_node(self, node_id: int) -> dict[str, Any] | None:
        nodes = self.all_nodes("n")
        row = nodes.where(F.col("n.id") == node_id).first() if nodes is not None else None
        return None if row is None else {"id": row["n"]["id"], "labels": list(row["n"]["labels"]), "properties": {k: v for k, v in row["n"]["p"].asDict(True).items() if v is not None and k != "_"}}

    def get_edge(self, edge_id: int) -> dict[str, Any] | None:
        for e in self.edges.values():
            row = e.df.where(F.col("id") == edge_id).first()
            if row is not None:
                return {"id": row["id"], "type": e.type, "source": row["source"], "target": row["target"], "properties": {k: v for k, v in row.asDict(True).items() if k not in SYSTEM and v is not None}}
        return None

    def find_nodes(self, label: str | None = None, properties: dict[str, Any] | None = None) -> DataFrame:
        """Ids of nodes with a label and equal properties."""
        found = self.node_scan([label] if label else [], set(properties or ()), "n")
        if found is None:
            return self.spark.createDataFrame([], "node_id long")
        have = found.schema["n"].dataType["p"].dataType.fieldNames()
        for k, v in (properties or {}).items():
            found = found.where(F.col(f"n.p.`{k}`") == F.lit(v)) if k in have else found.limit(0)
        return found.select(F.col("n.id").alias("node_id"))

    def find_edges(self, source: int | None = None, target: int | None = None, type: str | None = None) -> DataFrame:
        out = None
        for e in self.edge_tables([type] if type else []):
            df = e.df
            for column, value in (("source", source), ("target", target)):
                df = df if value is None else df.where(F.col(column) == value)
            one = df.select(F.col("id").alias("rel_id"), F.lit(e.type).alias("rel_type"), "source", "target")
            out = one if out is None else out.unionAll(one)
        return out if out is not None else self.spark.createDataFrame([], "rel_id long, rel_type string, source long, target long")

    def neighbours(self, node_id: int, direction: str = "out", type: str | None = None) -> DataFrame:
        return self.expand(node_id, direction, type).select("other")

    def expand(self, node_id: int, direction: str = "out", type: str | None = None) -> DataFrame:
        """(rel_id, other, type, props) of one hop."""
        tables = self.edge_tables([type] if type else [])
        if not tables:
            return self.spark.createDataFrame([], "rel_id long, other long, type string, props string")
        hop = self.edge_scan(tables, None, direction, "").where(F.col("near") == node_id)
        return hop.select(F.col("rel.id").alias("rel_id"), F.col("far").alias("other"), F.col("rel.type").alias("type"), F.to_json("rel.p").alias("props"))

    # --- writing: copy on write, one row of a delta or many

    def new_ids(self, kind: str, n: int) -> int:
        """Reserve ``n`` ids and tell the first."""
        first = self.next_id[kind]
        self.next_id[kind] += n
        return first

    def put_nodes(self, labels: tuple[str, ...], df: DataFrame) -> None:
        """Append nodes (id and properties) that carry ``labels``."""
        name = "+" + ":".join(labels)
        self.touch("node", df)
        if name in self.nodes:
            old = self.nodes[name]
            self.nodes[name] = replace(old, df=self._grown(f"node {name}", _append(old.df, df)))
        else:
            self.nodes[name] = NodeTable(df, labels)

    def put_edges(self, type: str, df: DataFrame) -> None:
        """Append edges (id, source, target and properties)."""
        name = "+" + type
        self.touch("edge", df, type)
        if name in self.edges:
            old = self.edges[name]
            self.edges[name] = replace(old, df=self._grown(f"edge {name}", _append(old.df, df)))
        else:
            self.edges[name] = EdgeTable(type, df)

    def touch(self, kind: str, ids: DataFrame, type: str | None = None) -> None:
        """Note whose ids a write changes; change feeds and views look at these alone."""
        self.touched.append((kind, ids.select("id"), type))

    def _grown(self, name: str, df: DataFrame) -> DataFrame:
        """A table after one more append, written down from time to time so that plans stay short."""
        self.appended[name] = self.appended.get(name, 0) + 1
        return materialise(df) if self.appended[name] % APPENDS == 0 else df

    def snapshot(self) -> Graph:
        """A copy that later writes do not touch; tables are immutable and shared."""
        out = Graph(self.spark)
        out.nodes, out.edges, out.ordinals = dict(self.nodes), dict(self.edges), dict(self.ordinals)
        out.touched = list(self.touched)
        out.next_id, out.indexes, out.constraints, out.procedures = dict(self.next_id), set(self.indexes), set(self.constraints), dict(self.procedures)
        return out

    def restore(self, other: Graph) -> None:
        self.nodes, self.edges, self.next_id, self.touched = dict(other.nodes), dict(other.edges), dict(other.next_id), list(other.touched)

    def create_node(self, labels: list[str], properties: dict[str, Any] | None = None) -> int:
        node = self.new_ids("node", 1)
        row = {"id": node} | {k: v for k, v in (properties or {}).items() if v is not None}
        self._written(lambda: self.put_nodes(tuple(sorted(set(labels))), _one_row(self.spark, row)))
        return node

    def create_edge(self, source: int, target: int, type: str, properties: dict[str, Any] | None = None) -> int:
        for end in (source, target):
            if self.get_node(end) is None:
                raise ArgumentError("EntityNotFound", f"node {end}")
        edge = self.new_ids("edge", 1)
        row = {"id": edge, "source": source, "target": target} | {k: v for k, v in (properties or {}).items() if v is not None}
        self._written(lambda: self.put_edges(type, _one_row(self.spark, row)))
        return edge

    def _written(self, change) -> None:
        before = self.snapshot()
        change()
        try:
            self.check_constraints()
        except ConstraintError:
            self.restore(before)
            raise
        for listener in self.listeners:
            listener(before, self)

    def update_node(self, node_id: int, properties: dict[str, Any]) -> None:
        """Replace the properties of a node."""
        self._written(lambda: self.change_nodes(self.spark.createDataFrame([(node_id,)], "id long"), {k: F.lit(v) for k, v in properties.items()}, replace_all=True))

    def delete_node(self, node_id: int) -> None:
        if not self.expand(node_id, "both").isEmpty():
            raise ConstraintError("DeleteConnectedNode", str(node_id))
        self.detach_delete_node(node_id)

    def detach_delete_node(self, node_id: int) -> None:
        self._written(lambda: self.drop_nodes(self.spark.createDataFrame([(node_id,)], "id long")))

    def delete_edge(self, edge_id: int) -> None:
        self._written(lambda: self.drop_edges(self.spark.createDataFrame([(edge_id,)], "id long")))

    def add_label(self, node_id: int, label: str) -> None:
        self._written(lambda: self.change_labels(self.spark.createDataFrame([(node_id,)], "id long"), [label], []))

    def remove_label(self, node_id: int, label: str) -> None:
        self._written(lambda: self.change_labels(self.spark.createDataFrame([(node_id,)], "id long"), [], [label]))

    def change_nodes(self, delta: DataFrame, values: dict[str, Column], replace_all: bool = False) -> None:
        """Set properties on the nodes whose ids ``delta`` holds; values may use its columns."""
        self.touch("node", delta)
        self.nodes = {n: replace(t, df=_changed(t.df, delta, values, replace_all, {"id", "labels"})) for n, t in self.nodes.items()}

    def change_edges(self, delta: DataFrame, values: dict[str, Column], replace_all: bool = False) -> None:
        self.touch("edge", delta)
        self.edges = {n: replace(e, df=_changed(e.df, delta, values, replace_all, {"id", "source", "target"})) for n, e in self.edges.items()}

    def change_labels(self, delta: DataFrame, add: list[str], drop: list[str]) -> None:
        self.touch("node", delta)
        out = {}
        for n, t in self.nodes.items():
            marked = t.df.withColumn("labels", t.label_column()).join(delta.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
            new = F.array_union(F.array_except("labels", F.array(*(F.lit(x) for x in drop)).cast("array<string>")), F.array(*(F.lit(x) for x in add)).cast("array<string>"))
            df = marked.withColumn("labels", F.when(F.col("__id").isNotNull(), new).otherwise(F.col("labels"))).drop("__id")
            fixed = tuple(x for x in t.labels if x not in drop)
            out[n] = NodeTable(df.select("id", "labels", *(c for c in df.columns if c not in ("id", "labels"))), fixed, (t.dynamic | set(t.labels) | set(add)) - set(fixed))
        self.nodes = out

    def drop_nodes(self, ids: DataFrame) -> None:
        """Delete nodes and every edge at them."""
        gone = ids.select(F.col("id").alias("__gone")).distinct()
        self.touch("node", ids)
        for e in self.edges.values():
            for end in ("source", "target"):
                self.touch("edge", e.df.join(gone, F.col(end) == F.col("__gone"), "left_semi"), e.type)
        self.nodes = {n: replace(t, df=t.df.join(gone, F.col("id") == F.col("__gone"), "left_anti")) for n, t in self.nodes.items()}
        for end in ("source", "target"):
            self.edges = {n: replace(e, df=e.df.join(gone, F.col(end) == F.col("__gone"), "left_anti")) for n, e in self.edges.items()}

    def drop_edges(self, ids: DataFrame) -> None:
        gone = ids.select(F.col("id").alias("__gone")).distinct()
        self.touch("edge", ids)
        self.edges = {n: replace(e, df=e.df.join(gone, F.col("id") == F.col("__gone"), "left_anti")) for n, e in self.edges.items()}

    def clear(self) -> None:
        """Drop all data; registries of indexes and constraints stay."""
        self.touched.append(("all", None, None))
        self.nodes, self.edges, self.next_id = {}, {}, {"node": 1, "edge": 1}

    def settle(self) -> Graph:
        """Write all tables that writes have built up, so that plans stay short."""
        self.nodes = {n: replace(t, df=materialise(t.df)) for n, t in self.nodes.items()}
        self.edges = {n: replace(e, df=materialise(e.df)) for n, e in self.edges.items()}
        return self

    # --- indexes and constraints

    def create_node_index(self, label: str, prop: str) -> None:
        """Write the label's tables in the order of a property, so that scans for its values skip files and row groups by their statistics."""
        self.indexes.add((label, prop))
        for name, t in self.nodes.items():
            if t.may_have([label]) and prop in t.props:
                self.nodes[name] = replace(t, df=materialise(t.df.repartitionByRange(F.col(f"`{prop}`")).sortWithinPartitions(F.col(f"`{prop}`"))))

    def drop_node_index(self, label: str, prop: str) -> None:
        self.indexes.discard((label, prop))

    def show_indexes(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.indexes), "label string, property string")

    def create_constraint(self, label: str, prop: str, kind: str) -> None:
        self.constraints.add((label, prop, kind))
        try:
            self.check_constraints()
        except ConstraintError:
            self.constraints.discard((label, prop, kind))
            raise

    def drop_constraint(self, label: str, prop: str, kind: str | None = None) -> None:
        self.constraints = {c for c in self.constraints if c[:2] != (label, prop) or kind not in (None, c[2])}

    def show_constraints(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.constraints), "label string, property string, kind string")

    def check_constraints(self) -> None:
        """Raise where a node breaks a constraint."""
        for label, prop, kind in self.constraints:
            found = self.node_scan([label], {prop}, "n")
            if found is None:
                continue
            has = prop in found.schema["n"].dataType["p"].dataType.fieldNames()
            value = F.col(f"n.p.`{prop}`") if has else F.lit(None)
            bad = found.where(value.isNull()) if kind == "EXISTS" else found.where(value.isNotNull()).groupBy(value.alias("v")).count().where("count > 1")
            if not bad.isEmpty():
                raise ConstraintError("ConstraintValidationFailed", f"{kind} ({label}.{prop})")

    # --- queries

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Run a query and give its rows."""
        from skein.operators.compile import run

        return run(self, text, params or {})

    def explain(self, text: str, params: dict[str, Any] | None = None, analyze: bool = False) -> str:
        from skein.operators.explain import explain

        return explain(self, text, params or {}, analyze)


def _json(t: T.StructType, column: str) -> Column:
    return F.lit("{}") if t.fieldNames() == ["_"] else F.to_json(column)


def _one_row(spark: SparkSession, row: dict[str, Any]) -> DataFrame:
    from skein.functions.typed import literal

    return spark.range(1).select(*(literal(v).col.alias(k) for k, v in row.items()))


def _append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a property whose types have nothing in common becomes text."""
    ta, tb = ({f.name: f.dataType for f in x.schema} for x in (a, b))
    kinds = {n: common(ta.get(n, tb.get(n)), tb.get(n, ta.get(n))) or STRING for n in (*ta, *(n for n in tb if n not in ta))}
    side = lambda df, have: df.select(*(fit(Typed(F.col(f"`{n}`"), have[n]), t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in kinds.items()))
    return side(a, ta).unionAll(side(b, tb))


def _changed(df: DataFrame, delta: DataFrame, values: dict[str, Column], replace_all: bool, system: set[str]) -> DataFrame:
    new = delta.select(F.col("id").alias("__id"), *(v.alias(f"__{k}") for k, v in values.items())).dropDuplicates(["__id"])
    types = {f.name: f.dataType for f in new.schema}
    joined = df.join(new, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    out = []
    have = {f.name: f.dataType for f in df.schema}
    for c in df.columns:
        if c in values:
            t = common(have[c], types[f"__{c}"]) or STRING
            out.append(F.when(hit, fit(Typed(F.col(f"`__{c}`"), types[f"__{c}"]), t)).otherwise(fit(Typed(F.col(f"`{c}`"), have[c]), t)).alias(c))
        elif replace_all and c not in system:
            out.append(F.when(~hit, F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    for k in values:
        if k not in have:
            t = types[f"__{k}"]
            out.append(F.col(f"`__{k}`").cast(STRING if isinstance(t, T.NullType) else t).alias(k))
    return joined.select(*out)
