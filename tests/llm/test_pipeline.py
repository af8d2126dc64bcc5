"""The corpus pipeline against a plain version of all its stages."""

import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline
from tracelake.llm import common, language_id, mixing, pii

from .test_jaccard_join import brute
from .test_structured_operators import edf
from .test_text_operators import ids

SF = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by)
    w = {s: max(1, round(len(by[s]) ** mixing.ALPHA * 1000)) for s in names}
    p = max(mixing.SLOTS, 4 * len(names))
    free, total = p - len(names), sum(w.values())
    low = {s: w[s] * free // total for s in names}
    left = free - sum(low.values())
    extra = sorted(names, key=lambda s: (-(w[s] * free % total), s))[:left]
    share = [1 + low[s] + (s in extra) for s in names]
    slots = defaultdict(list)
    for t, i in enumerate(edf(share)):
        slots[names[i]].append(t)
    at = lambda s, b: b // len(slots[s]) * p + slots[s][b % len(slots[s])]
    end = min(at(s, -(-len(v) // mixing.BLOCK_DOCS)) for s, v in by.items())
    out = []
    for s, v in by.items():
        v.sort(key=lambda r: md5(f"{r['doc_id']}|{md5(r['text'] or '')}"))
        out += [r for k, r in enumerate(v) if at(s, k // mixing.BLOCK_DOCS) < end]
    return out


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    kept = [r for r in rows if language_id.has_letter(r["text"])]
    comp = {i: c for i, _, c in brute([(r["doc_id"], r["text"]) for r in kept])}
    kept = [r for r in kept if comp[r["doc_id"]] == r["doc_id"]]
    for r in kept:
        r["text"] = pii.redacted(r["text"], pii.find_spans(r["text"]))
    kept = plain_mix(kept)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(r["doc_id"], len(ids(r["text"]))) for r in kept}
    assert sum(r["length"] for r in got) == sum(len(ids(r["text"])) for r in kept)


@pytest.mark.parametrize("bits", [4, 28])
def test_rows_without_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "LEAST_BITS", min(bits, 16))
    monkeypatch.setattr(common, "MOST_BITS", bits)
    names = ["k", "_bits", "_hit", "_key", "_bucket", "_slot", "u0"]
    rows = spark.createDataFrame([(i % 50 if i < 190 else None, str(i), True, i, None, "s", "u") for i in range(200)], "k long, a string, b boolean, c long, d long, e string, f string").toDF(*names)
    drop = spark.createDataFrame([(i,) for i in range(0, 80, 7)], "k long")
    out = common.without(rows, drop, "k")
    assert out.columns == names
    got = sorted(r["_key"] for r in out.collect() if r["_hit"] and r["_bucket"] is None and r["_bits"] == str(r["_key"]))
    assert got == [i for i in range(200) if i >= 190 or (i % 50) % 7]
    assert common.without(rows, drop.limit(0), "k").count() == 200


#: Names that stages use inside or add, here columns of the user's.
CLASHING = ["lang_pred", "score", "_text", "_bits", "_bucket", "_hit", "_key", "_slot", "_name", "in_target", "slot", "block", "position", "_r", "_h", "_b", "_tie", "_src", "share", "u0", "u5", "n", "k", "t", "component_id", "n_shingles", "count", "held_out"]


def test_stages_keep_columns_of_any_name(spark):
    base = [(i, f"the words of document {i} and more of them {i * 7}", "en", f"s{i % 3}", 9) for i in range(40)] + [(50, None, None, None, None), (51, "12 34", None, "s0", 5), (3, "the words of document 3 and more of them 21", "en", "s0", 9)]
    rows = [(*r, *(f"{c} of {j}" for c in CLASHING)) for j, r in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)
    x, alive = df, {r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, SF)
        assert x.columns == df.columns and x.dtypes == df.dtypes
        got = [tuple(r)[5:] for r in x.collect()]
        assert len(set(got)) == len(got) and set(got) <= alive, name
    assert len(got) == 40
    pieces = corpus_pipeline.STAGES[-1][1](spark, x, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(range(40))


def test_stages_keep_the_columns_and_odd_rows(spark):
    docs = [(1, None, "en", "s", 0), (2, "12 34", None, None, 5), (3, "the and of the and", "en", "s", 9), (3, "the and of the and", "en", "s", 9), (4, "der die das und mail a@b.co", None, None, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    x = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, SF)
        assert x.columns == df.columns and x.dtypes == df.dtypes
        if name == "ngram_jaccard_join":
            assert sorted(r["doc_id"] for r in x.collect()) == [3, 4]
        if name == "personal_data":
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in x.collect()}[4] == ("der die das und mail <EMAIL>", 28)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900001, "Γειά σου κόσμε, τι κάνεις σήμερα " * 5), (900002, "Привет мир " * 9), (900003, "你好世界今天怎么样" * 9), (900004, "qzxkvw wqxzkj zzqxwk vvkqxz " * 20), (900005, "½ ²")]
    more = docs.union(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string)"))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, more, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if language_id.has_letter(r["text"])}
