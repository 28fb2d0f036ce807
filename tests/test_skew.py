"""The queries hold when one customer, one order and one price have a third of
all rows."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "orders": """
        SELECT * REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey,
            CASE WHEN o_orderkey % 3 = 1 THEN 123456.0 ELSE o_totalprice END AS o_totalprice
        ) FROM '{path}'
    """,
    "lineitem": """
        SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey)
        FROM '{path}'
    """,
}
NAMES = """
clean_table distribution_price group_mean_top15 reconcile top_n_group feature_table
sample_rows group_split feature_table_by_side string_index impute_median metrics
scan_partitioned ridge_two_features tree_of_two_levels
""".split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    duck = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "nation"):
        path = f"{SOURCE}/{name}.parquet"
        rows = HOT.get(name, "SELECT * FROM '{path}'").format(path=path)
        duck.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), duck


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, skewed, name):
    folder, duck = skewed
    result = entry_module.queries()[name](spark, folder)
    expected = duck.sql(entry_module.oracle_sql()[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    ours = sorted((tuple(row[c] for c in columns) for row in result.collect()), key=repr)
    places = [expected.columns.index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in places) for row in expected.fetchall()), key=repr)
    assert ours == theirs
