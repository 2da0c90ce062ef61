"""The plan of a query as text: its clauses, Spark's estimate of the result, and Spark's own plan with estimates."""

from __future__ import annotations

import time
from typing import Any

from skein.plans import ast as A
from skein.plans.parser import parse


def _line(c: A.Clause) -> str:
    name = type(c).__name__
    if isinstance(c, A.Match):
        hops = [f"({':'.join(p.nodes[0].labels)})" + "".join(f"-[{'|'.join(r.types)}{'*' if r.span else ''} {r.direction}]-({':'.join(n.labels)})" for r, n in zip(p.rels, p.nodes[1:], strict=True)) for p in c.patterns]
        return f"{'OptionalMatch' if c.optional else 'Match'} {', '.join(hops)}" + (" + Filter" if c.where is not None else "")
    if isinstance(c, (A.With, A.Return)):
        b = c.body
        parts = ["Project " + ("*" if b.star else ", ".join(i.alias or i.expr.text for i in b.items))]
        parts += ["Distinct"] * b.distinct + ["OrderBy"] * bool(b.order) + ["Skip"] * (b.skip is not None) + ["Limit"] * (b.limit is not None)
        return f"{name} " + " > ".join(parts)
    if isinstance(c, A.Unwind):
        return f"Unwind {c.of.text} AS {c.var}"
    return name


def _tree(q: A.Query, depth: int = 0) -> list[str]:
    out = []
    for c in q.clauses:
        out.append("  " * depth + _line(c))
        if isinstance(c, A.SubQuery):
            out += _tree(c.query, depth + 1)
    if q.union:
        out += ["  " * depth + ("UnionAll" if q.union[0] else "Union"), *_tree(q.union[1], depth)]
    return out


def explain(graph, text: str, params: dict[str, Any], analyze: bool = False) -> str:
    """With ``analyze`` the query is run, writes included."""
    from skein.operators.compile import run

    started = time.perf_counter()
    query = parse(text)
    target = graph if analyze else graph.snapshot()
    df = run(target, text, params)
    lines = _tree(query) + [f"Planning: {(time.perf_counter() - started) * 1000:.1f} ms"]
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    lines.append(f"Estimate: {rows.get() if rows.isDefined() else 'unknown'} rows, {stats.sizeInBytes()} bytes")
    if analyze:
        started = time.perf_counter()
        lines.append(f"Rows: {df.count()} in {(time.perf_counter() - started) * 1000:.1f} ms")
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
    return "\n".join([*lines, plan])
