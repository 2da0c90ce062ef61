"""Bounds raise where going on would leave something out."""

import pytest

from skein.errors import ArgumentError
from skein.operators import compile as compiler
from skein.sources.graph import Graph


def test_shortest_path_beyond_the_cap_raises(spark, monkeypatch):
    monkeypatch.setattr(compiler, "MAX_HOPS", 3)
    g = Graph(spark)
    g.query("CREATE (:P {v: 0})-[:N]->(:P {v: 1})-[:N]->(:P {v: 2})-[:N]->(:P {v: 3})-[:N]->(:P {v: 4})-[:N]->(:P {v: 5})")
    far = "MATCH p = shortestPath((a:P {v: 0})-[:N*%s]->(b:P {v: %d})) RETURN length(p) AS n"
    for span in ("", "1..10"):
        with pytest.raises(ArgumentError, match="PathTooLong|more than 3"):
            g.query(far % (span, 5)).collect()
    assert [r["n"] for r in g.query(far % ("", 3)).collect()] == [3]
    assert g.query(far % ("1..3", 5)).collect() == []
