"""Path queries over all events, not over a few ids."""

import pytest
from test_oracles import SF, duck, plain  # noqa: F401

from skein.queries import CYPHER, ORACLE_SQL, QUERIES

ALL = ("var_zero", "var_both", "var_rel_list", "path_nodes")


@pytest.mark.parametrize("name", ALL)
def test_all_events_equal_the_sql(spark, duck, name):  # noqa: F811
    assert "WHERE" not in CYPHER[name]
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
    events = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    paths = {"var_both": lambda: len(got), "path_nodes": lambda: len(got), "var_zero": lambda: got[0][0], "var_rel_list": lambda: sum(r[columns.index("c")] for r in got)}[name]()
    assert paths > 0.5 * events
