"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(rows.columns) == sorted(columns)
    mine = sorted(str([shown(r[c]) for c in sorted(columns)]) for r in rows.collect())
    other = sorted(str([shown(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    assert mine == other


def test_tree_of_an_unknown_name(spark):
    from quarry.operators.graph import call_tree
    from quarry.plans.adapters import Relations

    r = Relations(spark, SF)
    with pytest.raises(LookupError):
        call_tree(r.functions, r.deps, "no such name")


def test_call_tree_survives_cycles(spark):
    from quarry.operators.graph import call_tree

    f = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 5), (3, "b", "y", 1)], "id long, name string, file_path string, line_start int")
    d = spark.createDataFrame([(1, "b"), (2, "a"), (2, "ext"), (3, "other")], "caller_id long, callee_name string")
    out = {r.name: (r.depth, r.known, r.callees) for r in call_tree(f, d, "a").collect()}
    assert out == {"a": (0, True, "b"), "b": (1, True, "a,ext"), "ext": (2, False, "")}


def test_call_tree_of_a_deep_chain(spark):
    from quarry.operators.graph import call_tree

    n = 105
    f = spark.createDataFrame([(i, f"f{i}", "x", i) for i in range(n)], "id long, name string, file_path string, line_start int").coalesce(1)
    d = spark.createDataFrame([(i, f"f{i + 1}") for i in range(n)], "caller_id long, callee_name string").coalesce(1)
    out = {r.name: (r.depth, r.known) for r in call_tree(f, d, "f0").collect()}
    assert out == {f"f{i}": (i, i < n) for i in range(n + 1)}


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10


def test_paren_depth_column(spark):
    from pyspark.sql import functions as F

    from quarry.functions.columns import paren_depth

    rows = spark.createDataFrame([("f(g(x))",), ("",), (")(",), ("a",)], "t string").select(paren_depth(F.col("t")).alias("d"))
    assert [r.d for r in rows.collect()] == [2, 0, 1, 0]
