"""Sample-graph queries against their SQL in DuckDB."""

import duckdb
import pytest

from skein.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SOME = (
    "nation_revenue", "scan_all_labels", "expand_both", "rel_unique", "optional_outer", "var_bounded", "var_both", "path_rels", "all_shortest", "exists_or", "call_top", "agg_stats", "int_arith", "entity_fns", "crud_create", "view_delta",
    "path_ends", "path_quantified", "rules", "zoned", "zone_names", "mixed_values", "mixed_lists", "merge_rows", "merge_rel", "indexes", "save_load", "relational", "json_rows", "api_writes", "view_delta_rel", "view_delta_agg", "view_rules",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["nation", "items", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and QUERIES.keys() <= entry.queries().keys()
