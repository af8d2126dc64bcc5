"""Edge rules of the operators on hand-built rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import providers, schemas
from tracelake.functions import metrics, stats, text
from tracelake.operators import agent, agreement, benchmarks, citing, corpus, graph, judging, reports, retrieval, router_model, routing, runs, significance, vectors
from tracelake.scratch import average_ranks, following
from tracelake.sources import files
from tracelake.streaming.append import append_stream


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def arr(*v):
    return F.array(*(F.lit(x) for x in v)).cast("array<string>")


# --- metrics, text, statistics


def test_set_metrics_of_empty_sets(spark):
    r = one(spark, **{f"a_{k}": v for k, v in metrics.scores(arr(), arr("A"), arr("A")).items()}, **{f"b_{k}": v for k, v in metrics.scores(arr("A"), arr(), arr()).items()})
    assert (r["a_citation_precision"], r["a_citation_f1"], r["a_retrieval_recall"]) == (0, 0, 1)
    assert (r["b_citation_precision"], r["b_citation_recall"], r["b_retrieval_recall"], r["b_context_precision"]) == (0, 0, 0, 0)
    r = one(spark, f=metrics.scores(arr("A", "B"), arr("B", "C", "D"), arr())["citation_f1"], j=metrics.jaccard(arr(), arr()))
    assert math.isclose(r["f"], 0.4) and r["j"] == 0


def test_id_lists(spark):
    r = one(spark, s=files.split_ids(F.lit("A;; A ;B")), n=files.split_ids(F.lit(None).cast("string")), j=files.join_ids(arr("A", "B")))
    assert (r["s"], r["n"], r["j"]) == (["A", "B"], [], "A;B")


def test_identifiers(spark):
    r = one(spark, i=text.ids_in(F.lit("ADS-014 FCC-022 ADS-014 DO-178C SHA-256")))
    assert r["i"] == ["ADS-014", "FCC-022", "SHA-256"]


def test_citations(spark):
    ids = spark.createDataFrame([("HMI-090",), ("ALX2-AUTO-001",), ("AUTO-001",), ("AUTO-001",), ("plain",), (None,), ("A-B-C-D",), ("B-C",)], "id string")
    texts = {
        1: "ALX2-AUTO-001, HMI-105, SHA-256 and HMI-105", 2: None, 3: "no ids", 4: "x-AUTO-001-HMI-090 AUTO-001", 5: "HMI-A2-b7 HMI-7x HMI-X-9-HMI-3 HMI-", 6: "A-B-C-E A-B-C-D B-C-9 HMI-090-4", 7: "aHMI-105 HMI-090x",
    }
    df = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(3)
    got = {r["k"]: (r["cited"], r["invented"]) for r in citing.citations(df, ids, "k", "t").collect()}
    assert got == {
        1: (["ALX2-AUTO-001"], ["HMI-105"]), 2: ([], []), 3: ([], []), 4: (["AUTO-001", "HMI-090"], []), 5: ([], ["HMI-A2", "HMI-X-9-HMI-3"]), 6: (["B-C", "A-B-C-D", "HMI-090"], []), 7: ([], []),
    }
    assert all(r["cited"] == [] for r in citing.citations(df, ids.limit(0), "k", "t").collect())


def test_text_helpers(spark):
    r = one(
        spark, a=text.critic_verdict(F.lit('```{"verdict": "continue"} {"x":1}```')), b=text.critic_verdict(F.lit("no json")), c=text.judge_verdict(F.lit('sure: {"faithful": true, "r": "{}"} ok')),
        d=text.judge_verdict(F.lit("x")), e=text.strip_quotes(F.lit(' "hi" ')), f=text.shorten(F.lit("abcdef"), 3), g=text.is_transient(F.lit("openai.RateLimitError: slow")), h=text.token_count(F.lit("  a b\nc ")),
        i=text.token_count(F.lit("")), j=text.has_any(F.lit("after systems"), ("ft",)),
    )
    assert list(r) == ["continue", "sufficient", True, None, "hi", "abc…", True, 3, 0, True]


@pytest.mark.parametrize("q, rule, to", [
    ("What does ADS-014 specify about pitot blockage detection?", "R2", "vanilla"),
    ("How does NAV reach FCC?", "R3", "graphrag"),
    ("Which items trace to ADS-014?", "R1", "agentic-graph"),
    ("what satisfies the need", "R4", "graphrag"),
    ("latency budget of ADS data", "R5", "vanilla"),
    ("hello", "default", "agentic"),
])
def test_router_v1(spark, q, rule, to):
    r = routing.route_v1(spark.createDataFrame([(q,)], "query string")).first()
    assert (r["rule"], r["pipeline"]) == (rule, to)


def test_statistics_of_tables(spark):
    c = lambda *v: [F.lit(x) for x in v]
    lo, hi = stats.wilson(F.lit(5.0), F.lit(5.0))
    r = one(spark, k=stats.kappa(*c(20, 5, 10, 15)), k1=stats.kappa(*c(9, 0, 0, 0)), k0=stats.kappa(*c(0, 0, 0, 0)), a=stats.ac1(*c(9, 0, 0, 0)), m=stats.mcnemar_p(*c(3, 9)), m0=stats.mcnemar_p(*c(0, 0)), m1=stats.mcnemar_p(*c(0, 3)), hi=hi, lo=lo, w0=stats.wilson(F.lit(0.0), F.lit(0.0))[0], f=stats.fisher_p(*c(3, 1, 1, 3)), f0=stats.fisher_p(*c(0, 0, 0, 0)), f1=stats.fisher_p(*c(5, 0, 0, 5)))
    assert math.isclose(r["k"], 0.4) and r["k1"] is None and r["k0"] is None and r["a"] == 1
    assert math.isclose(r["m"], 2 * sum(math.comb(12, i) for i in range(4)) / 2**12) and r["m0"] is None and math.isclose(r["m1"], 0.25)
    assert r["hi"] == 1 and math.isclose(r["lo"], 0.565518, abs_tol=1e-6) and r["w0"] is None
    assert math.isclose(r["f"], 34 / 70, abs_tol=1e-9) and math.isclose(r["f1"], 2 / 252, abs_tol=1e-9) and r["f0"] is None


def test_trend_is_null_without_variation(spark):
    v = spark.createDataFrame([("a", "1-hop", True), ("a", "2-hop", True), ("b", "1-hop", True), ("b", "1-hop", True), ("b", "3+-hop", False), ("b", "2-hop", None)], "k string, s string, faithful boolean")
    got = {r["k"]: r for r in agreement.trend(v, ["k"], "s", list(schemas.STRATA)).collect()}
    assert got["a"]["trend_z"] is None and got["b"]["trend_z"] < 0 and math.isclose(got["b"]["fisher_p"], 1 / 3)


def test_p_values(spark):
    r = spark.createDataFrame([(1.96,), (None,)], "z double").select(stats.two_sided_p("z").alias("p"), stats.upper_p("z").alias("u")).collect()
    assert math.isclose(r[0]["p"], 0.0499957, abs_tol=1e-6) and math.isclose(r[0]["u"], 0.0249979, abs_tol=1e-6) and r[1]["p"] is None


def test_fleiss(spark):
    rows = [("a", i, v) for i, vs in enumerate([(1, 1, 1), (0, 0, 0), (1, 0, 1)]) for v in vs] + [("b", 1, 1), ("c", 1, 1), ("c", 1, 0), ("c", 2, 1)]
    got = {r["k"]: r for r in agreement.fleiss(spark.createDataFrame(rows, "k string, item int, rating int").withColumn("rating", F.col("rating").cast("boolean")), keys=("k",)).collect()}
    p = 5 / 9
    pe = p * p + (1 - p) ** 2
    assert math.isclose(got["a"]["fleiss_kappa"], ((1 + 1 + 1 / 3) / 3 - pe) / (1 - pe)) and got["b"]["fleiss_kappa"] is None and got["c"]["ragged"]


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "n string, p double")
    got = {r["n"]: (r["holm_p"], r["family_size"]) for r in significance.holm(t).collect()}
    assert got["d"] == (None, 3) and [round(got[k][0], 9) for k in "abc"] == [0.03, 0.06, 0.06]


def test_wilcoxon_and_cliff(spark):
    rows = [("s", float(i), float(i % 3)) for i in range(9)] + [("t", 1.0, 1.0), ("t", 2.0, 2.0)]
    long = spark.createDataFrame(rows, "k string, x double, y double").selectExpr("k", "'a' pipeline_i", "'b' pipeline_j", "x", "y")
    w = {r["k"]: r for r in significance.wilcoxon(long, ["k"]).collect()}
    assert w["t"]["z"] is None and w["t"]["n_nonzero"] == 0 and w["s"]["n_nonzero"] == 6 and w["s"]["w_plus"] == 21
    assert math.isclose(w["s"]["z"], 10.5 / math.sqrt(6 * 7 * 13 / 24 - 2 * 24 / 48))
    d = {r["k"]: r["delta"] for r in significance.cliffs_delta(long, ["k"]).collect()}
    want = np.mean([np.sign(i - j % 3) for i in range(9) for j in range(9)])
    assert math.isclose(d["s"], want) and d["t"] == 0


def test_joint_significance(spark):
    t = spark.createDataFrame([(True, 0.01, 0.2), (True, 0.01, 0.1), (None, 0.01, 0.9), (True, None, 0.9), (True, 0.04, -0.5)], "ci_excludes_zero boolean, holm_p double, cliffs_delta double")
    assert [r["significant"] for r in significance.joint_significance(t).collect()] == [True, False, False, False, True]


def test_bca_of_a_mean(spark):
    rng = np.random.default_rng(3)
    v = rng.exponential(size=400)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("b", 1, 2.0), ("c", 1, 2.0), ("c", 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r["k"]: r for r in significance.bca_mean(df, ["k"], "v", ["i"]).collect()}
    again = {r["k"]: r for r in significance.bca_mean(df.repartition(5), ["k"], "v", ["i"]).collect()}
    half = 1.96 * v.std() / 20
    assert abs(got["a"]["ci_lo"] - (v.mean() - half)) < half / 3 and abs(got["a"]["ci_hi"] - (v.mean() + half)) < half / 3
    assert math.isclose(got["a"]["ci_lo"], again["a"]["ci_lo"], rel_tol=1e-9) and got["a"]["method"] == "BCa"
    assert (got["b"]["method"], got["b"]["ci_lo"], got["c"]["method"]) == ("n<2", None, "constant")


# --- windows over ranges


@pytest.mark.parametrize("parts", [1, 7])
def test_following_and_ranks(spark, parts):
    rows = [(i % 3 if i < 900 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o long").repartition(5)
    want = {}
    for g, o in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(o)
    want = {(g, a): b for g, v in want.items() for a, b in zip(v, [*v[1:], None])}
    assert {(r["g"], r["o"]): r["next"] for r in following(df, "g", "o", "o", parts).collect()} == want
    x = df.filter("g is not null").withColumn("v", F.col("o") % 10)
    ranks = {}
    for r in average_ranks(x, ["g"], "v", parts).collect():
        ranks.setdefault(r["g"], []).append((r["v"], r["rank"]))
    for g, v in ranks.items():
        values = [a for a, _ in v]
        assert all(rank == sum(b < a for b in values) + (values.count(a) + 1) / 2 for a, rank in v)


def test_row_positions(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "o long").repartition(4)
    assert all(r["o"] == r["pos"] for r in runs.row_positions(df, "o", 9).collect())


# --- corpus, graph, retrieval


def test_chunks_and_links(spark):
    rows = [("A", "x" * 30, None, [("B", " references "), ("", "refines"), ("C", "mentions")]), ("B", "", "y" * 29, []), ("C", None, "z" * 31, None)]
    df = spark.createDataFrame(rows, f"id string, full_text string, text string, outgoing_links {schemas.LINKS}")
    c = corpus.chunks(df)
    assert {r["id"] for r in c.collect()} == {"A", "C"}
    m = {r["id"]: r for r in corpus.metadata(c).collect()}
    assert m["A"]["n_outgoing"] == 3 and m["C"]["n_outgoing"] == 0 and m["C"]["module"] == ""
    links = corpus.links(c)
    known = corpus.known_links(links)
    assert [tuple(r) for r in known.collect()] == [("A", "B", "REFERENCES")]
    assert [tuple(r) for r in corpus.unknown_types(links).collect()] == [("MENTIONS", 1)]
    assert [r["id"] for r in corpus.orphan_targets(known, c).collect()] == ["B"] and corpus.resolved(known, c).count() == 0
    assert corpus.nodes(df.withColumn("attributes", F.create_map(F.lit("k"), F.lit("v")))).filter("id = 'A'").first()["attrs_json"] == '{"k":"v"}'


def edges(spark, *e):
    return spark.createDataFrame([(a, b, r) for a, b, r in e], "src string, dst string, rel string")


def seeds(spark, *ids):
    return spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id int, id string, rank int")


def walked(spark, s, e, **kw):
    return [(r["id"], r["hops"]) for r in graph.walk_2hop(s, e, **kw).orderBy("rank").collect()]


def test_walk(spark):
    e = edges(spark, ("A", "B", "REFINES"), ("B", "C", "REFINES"), ("C", "D", "VERIFIES"))
    assert walked(spark, seeds(spark, "A"), e) == [("B", 1), ("C", 2)]
    assert walked(spark, seeds(spark, "A", "C"), e) == [("B", 1), ("D", 1)]
    assert walked(spark, seeds(spark, "A"), edges(spark, ("A", "B", "ALLOCATES_TO"))) == []
    star = edges(spark, *[("A", f"n{i:02d}", "REFINES") for i in range(40)])
    assert walked(spark, seeds(spark, "A"), star, cap=30) == [(f"n{i:02d}", 1) for i in range(30)]


def test_directed_lookup(spark):
    e = edges(spark, ("A", "B", "REFINES"), ("B", "A", "REFINES"))
    assert sorted((r["id"], r["dir"]) for r in graph.hop1_directed(seeds(spark, "A"), e).collect()) == [("B", "in"), ("B", "out")]


def test_pagerank(spark):
    e = edges(spark, ("A", "B", "REFINES"), ("B", "C", "REFINES"), ("X", "Y", "ALLOCATES_TO"))
    got = [(r["id"], r["score"]) for r in graph.walk_ppr(seeds(spark, "A"), e).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["B", "C"]
    assert graph.walk_ppr(seeds(spark, "X"), e).count() == 0 and graph.walk_ppr(seeds(spark, "none"), e).count() == 0
    mass = {"A": 1.0}
    near = {"A": ["B"], "B": ["A", "C"], "C": ["B"]}
    for _ in range(20):
        new = {"A": 0.15}
        for n, m in mass.items():
            for b in near[n]:
                new[b] = new.get(b, 0) + 0.85 * m / len(near[n])
        mass = new
    assert math.isclose(sum(mass.values()), 1) and all(math.isclose(s, mass[n], abs_tol=1e-8) for n, s in got)


def test_paths(spark):
    e = edges(spark, ("A", "B", "REFINES"), ("B", "C", "REFINES"), ("C", "A", "REFINES"), ("C", "D", "REFINES"))
    got = {tuple(r["nodes"]) for r in graph.paths(e, 3, 4).collect()}
    assert ("A", "B", "C", "D") in got and ("B", "C", "A", "B") not in got and ("C", "A", "B", "C", "D") in got and not any(p[0] == p[-1] for p in got)
    assert len(graph.paths(edges(spark, ("A", "B", "REFINES"), ("A", "B", "REFINES"), ("B", "C", "REFINES")), 2, 2).collect()) == 2
    node = spark.createDataFrame([(x, m) for x, m in zip("ABCD", "mmnn")], "id string, module string")
    assert {r["is_cross_module"] for r in graph.gold_records(graph.paths(e, 2, 2), node).filter("source_id = 'A'").collect()} == {True}


def test_context_merge(spark):
    extra = spark.createDataFrame([(1, f"n{i}", 1, i) for i in range(12)] + [(1, "s3", 1, 0)], "query_id int, id string, hops int, rank int")
    got = [(r["pos"], r["id"]) for r in retrieval.merged(seeds(spark, *[f"s{i}" for i in range(8)]), extra).orderBy("pos").collect()]
    assert [g[0] for g in got] == list(range(1, 16)) and [g[1] for g in got][:8] == [f"s{i}" for i in range(8)] and len({g[1] for g in got}) == 15
    chunk = spark.createDataFrame([("s0", "M", "H", "T")], "id string, module string, heading string, full_text string")
    rows = spark.createDataFrame([(1, "s0", 1), (1, "zz", 2)], "query_id int, id string, pos int")
    assert retrieval.formatted(retrieval.hydrate(rows, chunk)).first()["prompt"] == "[s0] (M :: H)\nT"
    assert retrieval.judge_context(retrieval.hydrate_or_say(rows, chunk)).first()["contexts"] == "[s0] T\n\n[zz] (text unavailable)"


def test_top_k_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, vector array<double>")
    q = v.withColumnRenamed("id", "query_id")
    got = {}
    for r in vectors.top_k(q, v, 2, block_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert got == {1: [(1, 0.0), (2, 0.0)], 2: [(1, 0.0), (2, 0.0)], 3: [(3, 0.0), (1, 1.0)]}
    assert vectors.top_k(q, v.limit(0), 2).count() == 0


# --- runs, files, agent, providers, router, stream


def test_resume_and_configs(spark):
    plan = runs.matrix(spark.createDataFrame([("q1",), ("q2",)], "query string"), runs.configs(spark, ["local"], skip=("adaptive", "remote_rerank")), 2)
    assert plan.count() == 2 * 2 * 5
    done = plan.filter("query = 'q1' and repeat = 0").withColumn("answer", F.lit("ERROR: x"))
    assert runs.pending(plan, done).count() == 15
    assert runs.summary(spark.createDataFrame([("p", -1, 5, ["A"]), ("p", 10, 20, ["A", "B"]), ("r", -1, 1, [])], "k string, latency_ms int, total_tokens int, cited_ids array<string>"), ["k"]).orderBy("k").collect()[0]["avg_ms"] == 10


def test_samples(spark):
    df = spark.createDataFrame([(i, f"g{i % 5}") for i in range(200)], "i long, g string")
    s = runs.stratified_sample(df, "g", 7, ["i"], 1).collect()
    assert len(s) == 5 and len({r["g"] for r in s}) == 5
    assert runs.merge_token_maps(spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2, "b": 5})], "k int, t map<string,int>"), "k", "t").first()["tokens"] == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        runs.merge_one_to_one(df.union(df.limit(1)), df, ["i", "g"])


def test_files(spark, tmp_path):
    chunk = [{"id": "A", "text": "t", "outgoing_links": [{"target_id": "B", "link_type": "refines"}]}, {"id": "B", "full_text": "u"}]
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(chunk[0]), "", json.dumps(chunk[1])]))
    assert files.read_chunks(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(x) for x in [{"query": "q", "expected_ids": ["A"]}, {"query": "q", "expected_ids": ["B"], "type": "1-hop"}, {"query": "r"}]))
    m = {r["query"]: (r["type"], r["expected_ids"]) for r in files.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert m == {"q": ("1-hop", ["B"]), "r": ("unknown", None)}
    (tmp_path / "r.csv").write_text('query,pipeline,latency_ms,cited_ids,verdict\n"a, b",vanilla,12,A;; B;A,x\n"say ""hi""\nnow",agentic,oops,,\n')
    r = files.read_runs(spark, str(tmp_path / "r.csv")).orderBy("pipeline").collect()
    assert [(x["query"], x["latency_ms"], x["cited_ids"]) for x in r] == [('say "hi"\nnow', None, []), ("a, b", 12, ["A", "B"])]
    doc = "#Requirement: R\nMODULE NAME: ADS\n\nHeader: SCOPE\n|| Requirement No:ADS-003 || Requirement: The ADS shall be dual.\nDerives From: ARP-1, ##PWR.PWR-012 ||\n\n|| Requirement No:ADS-004 || Requirement: Other. ||\n\nHeader: X\n|| Requirement No:ADS-005 || Requirement: Last. ||\n"
    (tmp_path / "d.md").write_text(doc)
    got = {x["id"]: x for x in files.requirement_records(spark, str(tmp_path / "d.md")).collect()}
    assert set(got) == {"ADS-003", "ADS-004", "ADS-005"} and got["ADS-003"]["full_text"] == "The ADS shall be dual." and got["ADS-005"]["heading"] == "X"
    assert [(link["target_id"], link["link_type"]) for link in got["ADS-003"]["outgoing_links"]] == [("ARP-1", "DERIVES_FROM"), ("PWR-012", "DERIVES_FROM")]
    df = spark.createDataFrame([(1, ["a"])], "i int, ids array<string>")
    files.write_report(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["ids"] == "a"
    index = str(tmp_path / "index")
    assert files.build_index(df, index) and not files.build_index(df, index) and files.build_index(df, index, force=True)
    files.append_new(spark.read.parquet(index), df.union(df.withColumn("i", F.lit(2))), index, ["i"])
    assert spark.read.parquet(index).count() == 2


def test_scores_of_runs(spark):
    r = spark.createDataFrame([("q", ["A", "A"], ["A", "B"]), ("none", [], [])], "query string, cited_ids array<string>, source_ids array<string>")
    m = spark.createDataFrame([("q", "1-hop", 1, ["A", "C"], False)], "query string, type string, hop_count int, expected_ids array<string>, is_cross_module boolean")
    x = runs.score(r, m).first()
    assert (x["citation_precision"], x["citation_recall"], x["context_precision"], x["n_cited"]) == (1, 0.5, 0.5, 1) and runs.unmatched(r, m).count() == 1


def test_agent(spark):
    q = spark.createDataFrame([(1, "about ADS-014"), (2, "what"), (3, "nothing")], "query_id int, query string")
    ranked = spark.createDataFrame([(g, 100 + i, i) for g in (1, 2) for i in range(1, 31)], "query_id int, id long, rank int")
    got = {r["query_id"]: r for r in agent.rounds(agent.start(q), ranked, F.size("chunks") >= 15).collect()}
    assert (got[1]["intent"], got[2]["verdict"], got[2]["iter_count"], len(got[2]["chunks"])) == ("id_lookup", "sufficient", 1, 20)
    assert (got[3]["verdict"], got[3]["iter_count"], got[3]["chunks"]) == ("continue", 3, [])


def test_providers(spark):
    e = providers.embedder("local")
    r = spark.createDataFrame([("the quick fox", "quick the fox"), ("", None)], "a string, b string").select(vectors.cosine(e.embed_document(F.col("a")), e.embed_document(F.col("b"))).alias("c"), F.size(e.embed_query(F.col("a"))).alias("n"), providers.TermOverlap().score(F.col("a"), F.col("b")).alias("o")).collect()
    assert math.isclose(r[0]["c"], 1) and r[0]["n"] == 64 and r[0]["o"] == 1 and r[1]["o"] == 0
    with pytest.raises(ValueError):
        providers.embedder("x")
    judge = providers.CitedInContext().faithful
    r = one(spark, a=judge(F.lit("see ADS-1"), arr("ADS-1")), b=judge(F.lit("see ADS-2"), arr("ADS-1")), c=judge(F.lit("ERROR: x"), arr()))
    assert list(r) == [True, False, None]


def test_router_v2(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "which list" if i % 2 else "how many", (rng.normal(size=6) + 4 * (i % 3)).tolist(), f"c{i % 3}") for i in range(90)]
    x = router_model.features(spark.createDataFrame(rows, "id long, query string, vector array<double>, target string"))
    p = router_model.out_of_fold(x, "target", "id", k=3)
    assert p.count() == 90
    f1 = router_model.report(p, "target").agg(F.avg("f1")).first()[0]
    assert f1 > 0.9


def test_stream_appends_once(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(src)
    for c in ("c1", "c2"):
        append_stream(spark.readStream.schema(df.schema).parquet(src), str(tmp_path / "log"), str(tmp_path / c), ["k"]).awaitTermination()
    spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    append_stream(spark.readStream.schema(df.schema).parquet(src), str(tmp_path / "log"), str(tmp_path / "c2"), ["k"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_judging(spark):
    r = spark.createDataFrame([("q", "p", 0, 5, "see ADS-1", ["ADS-1"]), ("q", "r", 0, 5, "see ADS-2", ["ADS-1"]), ("q", "s", 0, -1, "ERROR: x", [])], "query string, pipeline string, repeat int, latency_ms int, answer string, source_ids array<string>")
    judge = lambda q, ids, a: providers.CitedInContext().faithful(a, ids)
    j = judging.judged(r, {"one": judge, "two": lambda q, ids, a: F.lit(True)}, "2026-01-02")
    assert j.count() == 4 and judging.judged(r, {"one": judge}, "2026-01-02", done=j).count() == 0 and judging.judged(r, {"one": judge}, "2026-01-03", done=j).count() == 2
    w = {x["pipeline"]: (x["one"], x["two"]) for x in judging.wide(j, ["one", "two"]).collect()}
    assert w == {"p": (True, True), "r": (False, True)}
    f = judging.flips(j.filter("judge = 'one'"), j.filter("judge = 'two'"), judging.KEY, ["query"]).first()
    assert (f["n"], f["to_true"], f["flip_rate"]) == (2, 1, 0.5)
    judging.assert_complete(j, r, judging.KEY)
    with pytest.raises(ValueError):
        judging.assert_complete(r, r.limit(1), judging.KEY)


def test_reports(spark):
    c = spark.createDataFrame([("a", "s", 0.5, 0.4, 0.6, True), ("b", "s", 0.7, None, None, None), ("a", "t", None, None, None, None)], "p string, s string, mean double, ci_lo double, ci_hi double, sig boolean")
    t = reports.table(reports.marked_cells(c, "s", "p", significant="sig"), "p", "s", ["s", "t"])
    assert [tuple(r) for r in t.collect()] == [("a", "0.500 (0.40-0.60)+", "---"), ("b", "**0.700**", "---")]
    assert reports.markdown(t).splitlines()[2] == "| a | 0.500 (0.40-0.60)+ | --- |" and reports.latex(t).endswith("--- \\\\\n")
    o = spark.createDataFrame([(0.56, 0.44, 0.64)], "routed double, base double, oracle double")
    a = reports.acceptance(o, spark.createDataFrame([(0.01,), (0.2,), (None,)], "holm_p double")).first()
    assert (a["check_gain"], a["check_strata"], a["check_gap"], a["accepted"]) == (True, False, True, False)


def test_benchmark_helpers(spark):
    r = one(spark, a=benchmarks.hop_class(F.lit("3hop1__12_34")), b=benchmarks.hop_class(F.lit("x__1")), c=benchmarks.chain_text(arr("A", "B", "C"), arr("REFINES", "TESTS")), d=benchmarks.mapped(F.lit("inference"), benchmarks.REASONING))
    assert (r["a"], r["b"], r["d"]) == ("3hop", None, "2-hop") and r["c"] == "  Hop 0  [A]\n   --[REFINES]--> Hop 1  [B]\n   --[TESTS]--> Hop 2  [C]"
