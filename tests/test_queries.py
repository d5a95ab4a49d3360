"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, found):
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted(tuple(str(norm(r[c])) for c in sorted(columns)) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [r.asDict() for r in got.collect()]) == rows(want.columns, [dict(zip(want.columns, r)) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_corpus_is_read_once_and_ranked_early(spark):
    plan = QUERIES["maxsim_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
