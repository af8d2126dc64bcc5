"""Every registered query against its SQL on the smallest tables; queries without SQL give rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tracelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows)
    assert key(df.collect()) == key(want)


def test_bca_and_streams_without_sql(spark):
    rows = catalog.QUERIES["bca_intervals"](spark, SF).collect()
    assert len(rows) == 15 and all(r["ci_lo"] <= r["mean"] <= r["ci_hi"] for r in rows if r["method"] == "BCa")


def test_entry(spark):
    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "hops", "pos", "module", "heading"]
