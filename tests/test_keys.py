"""Relationship keys of the sample tables are unique or raise."""

import pytest
from pyspark.sql import functions as F

from skein.sources import tables
from skein.sources.tables import sample_graph

SF = "/root/testdata/sf0.001"


def test_keys_raise_beyond_their_room(spark, monkeypatch):
    same = "MATCH (:Supplier)-[r:SAME_NATION]->(:Supplier) RETURN id(r) AS k"
    lines = "MATCH (:Order)-[r:CONTAINS]->(:Part) RETURN id(r) AS k"
    ids = [r["k"] for r in sample_graph(spark, SF).query(lines).collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(tables, "LINES", 2)
    monkeypatch.setattr(tables, "SUPPLIERS", 3)
    for sf_dir, text in ((SF, lines), ("/root/testdata/sf0.01", same)):
        with pytest.raises(Exception, match="has room for"):
            sample_graph(spark, sf_dir).query(text).select(F.max("k")).collect()
