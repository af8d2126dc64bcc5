"""Tools as table functions."""

import pytest
from pyspark.errors import AnalysisException

from tracelake.operators import tools


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    tools.register(spark)


def test_graph_lookup(spark):
    links = [(1, "A", "n2", "h2", 1, "in", "REFINES"), (1, "A", "n9", "x" * 60, 0, "out", "VERIFIES"), (1, "A", "n1", None, 0, "out", "REFINES"), (1, "B", None, None, None, None, None), (2, "A", "n1", "h", 0, "out", "REFINES")]
    df = spark.createDataFrame(links, "query_id long, seed string, id string, heading string, d int, dir string, rel string").repartition(3)
    got = {(r[0], r[1]): r[2] for r in spark.sql("SELECT * FROM graph_lookup(TABLE({links}))", links=df).collect()}
    assert got[1, "A"] == f"Found 3 requirement(s) linked to A:\n  A -->[:REFINES]--> [n1] ()\n  A -->[:VERIFIES]--> [n9] ({'x' * 50})\n  A <--[:REFINES]<-- [n2] (h2)"
    assert got[1, "B"] == "No traceability links found involving B." and got[2, "A"].startswith("Found 1") and len(got) == 3
    assert spark.sql("SELECT * FROM graph_lookup(TABLE({links}))", links=df.limit(0)).count() == 0


def test_search_documents(spark):
    df = spark.createDataFrame([(1, 2, 8, "M", "two"), (1, 1, 7, "M", "one"), (2, None, None, None, None)], "query_id long, rank int, id long, module string, heading string")
    got = dict(spark.sql("SELECT query_id, summary FROM search_documents(TABLE({hits}))", hits=df).collect())
    assert got == {1: "Found 2 requirements:\n- [7] (M :: one)\n- [8] (M :: two)", 2: "No matching requirements found."}


def test_named_ids_beside_each_row(spark):
    df = spark.createDataFrame([(1, "AB-12 and XY-A3, AB-12"), (2, "none"), (3, None)], "k int, text string")
    got = spark.sql("SELECT k, i.pos, i.id FROM {df}, LATERAL named_ids(text) i", df=df).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, "AB-12"), (1, 1, "XY-A3")]


@pytest.mark.parametrize("sql", ["SELECT * FROM search_documents(TABLE(SELECT 1 AS query_id))", "SELECT * FROM graph_lookup(3)"])
def test_wrong_calls_say_why(spark, sql):
    with pytest.raises(AnalysisException, match="needs the columns|takes a table"):
        spark.sql(sql).collect()
