"""Every query against its DuckDB SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from homeward import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return f"{float(v):.6g}"
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    got = duck.execute(own.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_join_has_no_nested_loop(spark):
    plan = own.cell_feature_range_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["compare_rank_diff", "eligible_cells", "score_v1"])
def test_no_pairs_of_cells_and_features(spark, name):
    """Cells and features meet in one grouped map, not in a join whose pairs grow with the square."""
    plan = own.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroups") == 1 and "bcol" not in plan and "FlatMapGroups" not in plan
