"""Every registered query against its DuckDB oracle on the smallest data set."""

import math
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def _own(keys) -> set:
    """Without the training-data operators, which tests/llm covers."""
    return {k for k in keys if k != "pipeline" and not re.match(r"op\d+_", k)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "num_trips" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    q, s = queries(), oracle_sql()
    assert set(s) <= set(q)
    assert len(_own(q) - set(s)) <= 10


@pytest.mark.parametrize("key", sorted(set(oracle_sql())))
def test_query_matches_oracle(spark, con, key):
    sdf = queries()[key](spark, SF)
    rel = con.sql(oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert all(TYPES.get(t, t) == duck_types[c] for c, t in sdf.dtypes), (sdf.dtypes, duck_types)
    order = [rel.columns.index(c) for c in sdf.columns]
    s = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    assert s == d


@pytest.mark.parametrize("key", sorted(_own(queries()) - set(oracle_sql())))
def test_rows_only_queries_run(spark, key):
    assert queries()[key](spark, SF).count() > 0
