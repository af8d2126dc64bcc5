"""Chat rotation and mixing against their SQL and plain versions; neighbours against brute force; pages against their parts."""

import random

import duckdb
import numpy as np
import pytest

from tracelake.llm import ann, chat, html_text, mixing

SF = "/root/testdata/sf0.001"


def same(spark_df, sql, **tables):
    db = duckdb.connect()
    for k, v in tables.items():
        db.register(k, v)
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(spark_df.columns) == sorted(names)
    key = lambda rows: sorted(repr([r[c] for c in sorted(names)]) for r in rows)
    assert key(spark_df.collect()) == key(want)


TURNS = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "bob", "x" * 50), (1, 3, "bob", "x" * 50), (2, None, "user", "a"), (2, None, "cy", "zz"), (2, None, "user", "q" * 9), (2, -3, "cy", "m"), (2, 5, None, "b"), (None, 1, "user", "c"), (None, 2, "user", ""), (3, 0, "system", "only")]


def test_rotation(spark):
    import pandas as pd

    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, mask int")
    same(chat.rotate_perspectives(df, 2), chat.ORACLE, conversations=pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
    rows = [r for r in chat.rotate_perspectives(df, 2).collect() if r["conv_id"] == 1 and r["perspective"] == "bob"]
    whole = "".join(r["segment"] for r in sorted(rows, key=lambda r: r["start"]))
    assert whole.startswith("<|start|>system\ns<|end|>\n<|start|>user name=user\nhi")
    assert all(whole[r["start"] : r["stop"]] == r["segment"] for r in rows)
    assert {whole[r["content_start"] : r["stop"]] for r in rows if r["mask"]} == {"x" * 50 + "<|end|>\n"}


def edf(share):
    p, done, out = sum(share), [0] * len(share), []
    for t in range(p):
        due = [(-(-(done[i] + 1) * p // a), i) for i, a in enumerate(share) if done[i] < a and done[i] * p // a <= t]
        i = min(due)[1]
        out.append(i)
        done[i] += 1
    return out


def test_mix_keeps_all_rows_and_stays_within_a_block(spark):
    r = random.Random(4)
    names = ["a"] * 700 + ["b"] * 150 + ["c"] * 90 + [None] * 60
    rows = [(i, f"t{i}", s, 7) for i, s in enumerate(names)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").repartition(3)
    got = mixing.mix_sources(df, {"a": 5, "b": 3.5, "c": 1}, block_docs=4, slots=97).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(1000)) and len({x["position"] for x in got}) == 1000
    plan = {x["source"]: x["share"] for x in mixing.shares(df.groupBy("source").agg({"*": "count"}).toDF("source", "n"), 97, {"a": 5, "b": 3.5, "c": 1}, 0.5).collect()}
    order = [None, "a", "b", "c"]
    assert sum(plan.values()) == 97
    slots = {}
    for x in got:
        if x["in_target"]:
            assert slots.setdefault(x["slot"], x["source"]) == x["source"]
    assert sorted(slots) == list(range(len(slots)))
    cal = edf([plan[s] for s in order])
    assert [slots[t] for t in range(len(slots))] == [order[cal[t % 97]] for t in range(len(slots))]
    have = dict.fromkeys(order, 0)
    for t in range(len(slots)):
        have[slots[t]] += 1
        for s in order:
            assert abs(have[s] * 97 - (t + 1) * plan[s]) < 97
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mix_of_repeated_rows_and_missing_ids(spark):
    rows = [(None, f"t{i}", "a") for i in range(60)] + [(3, "same", "a")] * 20 + [(3, "other", "b"), (None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_sources(df, block_docs=2, slots=20).collect()
    assert len(got) == len(rows) and len({x["position"] for x in got}) == len(rows)
    assert sorted((str(x["doc_id"]), str(x["text"]), str(x["source"])) for x in got) == sorted(tuple(map(str, r)) for r in rows)


def test_a_calendar_of_many_sources_is_earliest_deadline_first(spark):
    r = random.Random(3)
    names = sorted(f"s{i:04}" for i in range(1500))
    share = [r.choice([1, 1, 2, 3, 9]) for _ in names]
    shared = spark.createDataFrame([(n, a, sum(share)) for n, a in zip(names, share)], "source string, share int, period int").repartition(5)
    got = sorted((x["t"], x["source"], x["k"]) for x in mixing.calendar(shared).collect())
    want, seen = edf(share), {}
    assert [x[1] for x in got] == [names[i] for i in want]
    for _, s, k in got:
        assert k == seen.get(s, 0)
        seen[s] = k + 1


def test_mix_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(mixing.mix_sources(docs, keep=["doc_id", "source"]), mixing.ORACLE, documents=docs.toPandas())


def brute(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-float(q @ v), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = s[:k]
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] + [0.0] * 7) for i in range(300, 400)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7), (480, []), (500, [1.0, None] + [0.0] * 6), (520, [1.0, 2.0]), (540, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(4)
    want, got = brute(rows, 20, 20), {}
    for r in ann.nearest(df, shard_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, len(g) + 1)) and all(x[1] != q for x in g)
        hit += len({x[1] for x in g} & {j for _, j in w})
    assert hit / sum(map(len, want.values())) > 0.98
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows, 20, 20), {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {j for _, j in w}) for q, w in want.items()) / sum(map(len, want.values())) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/x">menu</a></nav>
<div class="ad">buy now please do</div><div class="wrap{0}"><article><h1>Head &amp; more</h1><p><b>One  two<br><p>three<i>four</i> 1 < 2 &lt;b&gt;
<form>f</form><div class="comments">reader said</div></article></div><aside>side words</aside><footer>&copy; foot</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i), "k") for i in range(6)] + [(10, None, None, "k"), (11, "odd", "plain words", "k"), (12, "http://h.example/z", "<div><p>other layout of words", "k"), (13, "http://g/", "", "k"), (14, "http://g/", '<p class="x>a', "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()}
    want = "Head & more One two threefour 1 < 2 <b>"
    assert all(got[i] == (want, len(want)) for i in range(6))
    assert got[10] == ("", 0) and got[11][0] == "plain words" and got[12][0] == "other layout of words" and got[13] == ("", 0)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_marked_parts_of_an_article():
    page = (
        '<body><header><h1>Site</h1></header><div id="sidebarLeft">side side side</div><main class="post"><header><h1>Head</h1></header><p class="cookie-notice">cookies?<p>One <span class="ad">buy</span>two</p>'
        '<ul class="commentlist"><li>nice<li>bad</ul><p>Three<div style="display: none">hidden</div><table><tr><td>a<td>b</table><textarea>t</textarea><p>Four &#233; &nbsp; x</main><section id="comments">c c c</section></body>'
    )
    assert html_text.extract(page) == "Head One two Three a b Four é x"


def test_pages_of_the_corpus(spark):
    """The corpus's pages keep their prose in one article element."""
    import html as entities
    import re

    df = spark.read.parquet(f"{SF}/pages.parquet")
    src = {r["page_id"]: r["html"] for r in df.collect()}
    for r in html_text.main_text(df).collect():
        body = re.search(r"<article>(.*)</article>", src[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))
        assert r["text"] == " ".join(filter(None, (" ".join(entities.unescape(x).split()) for x in parts)))
