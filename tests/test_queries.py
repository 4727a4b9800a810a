"""Every registered query of the engine runs, and matches DuckDB where it has an oracle."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF_SMALL

SLOW = {"alignment_sweep", "prototype_k_sweep", "graph_signature", "persistence", "isomap", "align_relative"}


def catalogue():
    from vectorloom.plans import catalogue

    return catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF_SMALL}/{f}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{float(x):.5g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue().ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue().QUERIES[name](spark, SF_SMALL)
    found = duck.execute(catalogue().ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue().QUERIES) - set(catalogue().ORACLES) - SLOW))
def test_rows(spark, name):
    assert catalogue().QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
