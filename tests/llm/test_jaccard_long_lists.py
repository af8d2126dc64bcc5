"""Long index lists of copies that mostly don't link: pivots that settle nothing must not end the search."""

import random

import pytest

from tracelake.llm import jaccard_join as jj

from .test_jaccard_join import brute


def test_unlinked_family_equals_brute_force(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):  # two edits each: two copies link only if their edits are next to each other
        x = list(base)
        for p in r.sample(range(5, 115), 2):
            x[p] = f"e{i}_{p}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert 10 < len({c for _, _, c in want}) < 390
    assert {tuple(x) for x in jj.jaccard_components(df).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_long_lists_of_repeated_doc_ids(spark, monkeypatch, seed):
    """Several sets of one doc_id in lists that go through pivots: no answer of one is taken for another's."""
    monkeypatch.setattr(jj, "SMALL_LIST", 4)
    r = random.Random(seed)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(90)]
        for i in range(70):
            x = list(base)
            for p in r.sample(range(4, 86), r.choice([1, 2, 2, 3])):
                x[p] = f"e{r.randrange(30)}"
            rows.append((r.randrange(100), " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(x) for x in jj.jaccard_components(df).collect()} == brute(rows)
