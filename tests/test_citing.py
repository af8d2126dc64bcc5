"""Citations: the trie and the join against a brute-force reading."""

import random
import re

import pytest

from tracelake.operators import citing

IDS = ["AB-1", "AB-1-2", "AB-1-2-X", "REQ-12", "A-B", "REQ-A-3", "x_1-y", "plain", "AB-7-AB-1"]
WORDS = ["AB", "1", "2", "X", "REQ", "12", "A", "B", "3", "x_1", "y", "zz", "Q9", "A2", "_", "é", "7"]


def brute(text, ids):
    known = [i.split("-") for i in ids if "-" in i]
    families = {k[0] for k in known}
    cited, invented = [], []
    for token in re.findall(r"[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)+", text or ""):
        parts, taken, i = token.split("-"), set(), 0
        while i < len(parts):
            fits = [len(k) for k in known if parts[i : i + len(k)] == k]
            if fits:
                cited.append("-".join(parts[i : i + max(fits)]))
                taken |= set(range(i, i + max(fits)))
            i += max(fits, default=1)
        i = 0
        while i < len(parts):
            best = None
            if parts[i] in families and i not in taken:
                for j in range(i + 1, len(parts)):
                    if j in taken or not re.fullmatch(r"[A-Z0-9_]+", parts[j]):
                        break
                    if re.search(r"[0-9]$", parts[j]):
                        best = j
            if best:
                invented.append("-".join(parts[i : best + 1]))
            i = best + 1 if best else i + 1
    cited = list(dict.fromkeys(cited))
    return cited, [x for x in dict.fromkeys(invented) if x not in cited]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = [None, "", "-", "AB-1-2-X-9 and REQ-99; AB", "AB-1.AB-1-2,A-B-C3"]
    while len(out) < 10_000:
        out.append(r.choice(["", "see ", "("]) + r.choice([" ", ", ", "--"]).join("-".join(r.choice(WORDS) for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 4))))
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_both_ways_equal_brute_force(spark, texts, monkeypatch, most):
    monkeypatch.setattr(citing, "MOST_IDS", most)  # 3: the vocabulary is too large for a trie
    df = spark.createDataFrame(list(enumerate(texts)), "k int, answer string").repartition(4)
    plan = citing.citations(df, spark.createDataFrame([(i,) for i in IDS + IDS], "id string"), "k", "answer")
    assert ("MapInArrow" in plan._jdf.queryExecution().toString()) == (most > 3)
    got = {r["k"]: (r["cited"], r["invented"]) for r in plan.collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == brute(t, IDS), t


def test_long_identifiers_take_the_join(spark):
    ids = spark.createDataFrame([("A-" + "9" * 300,), ("B-1",)], "id string")
    df = spark.createDataFrame([(1, "B-1 A-" + "9" * 300)], "k int, answer string")
    assert citing.citations(df, ids, "k", "answer").first()["cited"] == ["B-1", "A-" + "9" * 300]
    assert citing.citations(df.limit(0), ids, "k", "answer").count() == 0
