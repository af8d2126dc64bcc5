"""The registered queries of the library's own operators, and their SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, stats, text
from ..operators import agent, agreement, benchmarks, citing, corpus, graph, judging, reports, retrieval, router_model, routing, runs, significance, vectors
from ..providers import CitedInContext, QuoteFirst
from ..scratch import folder, table
from ..schemas import STRATA
from ..sources.keyed import KeyedTable
from ..sources.vector_index import VectorIndex
from . import roles as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "graphrag_context"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- scores -----------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
g AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT l_orderkey, count(*) AS n_sources FROM s GROUP BY 1),
x AS (
  SELECT n.l_orderkey, n_sources, coalesce(nc, 0) AS n_cited, coalesce(ng, 0) AS n_gold, coalesce(cg, 0) AS cg, coalesce(sg, 0) AS sg FROM n
  LEFT JOIN (SELECT l_orderkey, count(*) AS nc FROM c GROUP BY 1) USING (l_orderkey)
  LEFT JOIN (SELECT l_orderkey, count(*) AS ng FROM g GROUP BY 1) USING (l_orderkey)
  LEFT JOIN (SELECT c.l_orderkey, count(*) AS cg FROM c JOIN g USING (l_orderkey, l_suppkey) GROUP BY 1) USING (l_orderkey)
  LEFT JOIN (SELECT s.l_orderkey, count(*) AS sg FROM s JOIN g USING (l_orderkey, l_suppkey) GROUP BY 1) USING (l_orderkey)),
p AS (SELECT *, CASE WHEN n_cited > 0 THEN cg / n_cited ELSE 0.0 END AS p, CASE WHEN n_gold > 0 THEN cg / n_gold ELSE 0.0 END AS r FROM x)
SELECT l_orderkey, CAST(n_sources AS INTEGER) AS n_sources, CAST(n_cited AS INTEGER) AS n_cited, CAST(n_gold AS INTEGER) AS n_gold,
       round(p, 6) AS citation_precision, round(r, 6) AS citation_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS citation_f1,
       round(CASE WHEN n_gold > 0 THEN sg / n_gold ELSE 0.0 END, 6) AS retrieval_recall, round(sg / n_sources, 6) AS context_precision
FROM p""")
def citation_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    sets = x.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("c"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("g"))
    m = metrics.scores(F.col("c"), F.col("g"), F.col("s"))
    return sets.select("l_orderkey", F.size("s").alias("n_sources"), F.size("c").alias("n_cited"), F.size("g").alias("n_gold"), *(r6(v).alias(k) for k, v in m.items()))


@query(ORACLES["citation_scores"].replace("\nSELECT l_orderkey, CAST(n_sources", ",\nz AS (SELECT l_orderkey, CAST(n_sources") + """)
SELECT o_orderpriority AS pipeline, count(*) AS n, round(avg(context_precision), 6) AS context_precision, round(avg(citation_precision), 6) AS citation_precision,
       round(CASE WHEN avg(context_precision) > 0 THEN avg(citation_precision) / avg(context_precision) END, 6) AS gain
FROM z JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def enrichment_gain(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("pipeline"))
    x = citation_scores(spark, sf).join(o, "l_orderkey").groupBy("pipeline").agg(F.count("*").alias("n"), F.avg("context_precision").alias("cp"), F.avg("citation_precision").alias("p"))
    return x.select("pipeline", "n", r6("cp").alias("context_precision"), r6("p").alias("citation_precision"), r6(F.when(F.col("cp") > 0, F.col("p") / F.col("cp"))).alias("gain"))


# --- corpus -----------------------------------------------------------------------------------------------------------


@query(f"WITH {R.SQL_CHUNKS} SELECT id, module, heading, level, object_type, full_text FROM chunks")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunks(spark, sf).select("id", "module", "heading", "level", "object_type", "full_text")


@query(f"WITH {R.SQL_CHUNKS} SELECT id, module, substring(heading, 1, 120) AS heading, level, object_type, 2 AS n_outgoing, 0 AS n_incoming FROM chunks")
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.metadata(R.chunks(spark, sf))


@query(f"WITH {R.SQL_EDGES} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def edge_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.edges(spark, sf).groupBy("rel").agg(F.count("*").alias("n"))


@query(f"WITH {R.SQL_LINKS} SELECT rel, count(*) AS n FROM links WHERE rel NOT IN ({R._in(R.LINK_TYPES)}) GROUP BY rel")
def unknown_link_types(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unknown_types(R.typed_links(spark, sf))


@query(f"WITH {R.SQL_LINKS} SELECT DISTINCT dst AS id FROM links WHERE rel IN ({R._in(R.LINK_TYPES)}) AND dst NOT IN (SELECT id FROM chunks)")
def orphan_targets(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.orphan_targets(corpus.known_links(R.typed_links(spark, sf)), R.chunks(spark, sf))


@query(f"WITH {R.SQL_CHUNKS} SELECT module, count(*) AS n FROM chunks GROUP BY module ORDER BY n DESC, module LIMIT 8")
def largest_modules(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunks(spark, sf).groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(8)


SQL_GOLD = f"""{R.SQL_RATINGS},
gold AS (SELECT source, doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM ratings WHERE a),
plain AS (SELECT source, doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM ratings WHERE NOT a)"""


@query(f"WITH {SQL_GOLD} SELECT source, src, dst FROM gold WHERE dst IS NOT NULL")
def consecutive_edges(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.consecutive_edges(R.ratings(spark, sf).filter("a"), "source", "doc_id")


@query(f"""WITH {SQL_GOLD} SELECT src, dst, false AS is_distractor FROM gold WHERE dst IS NOT NULL
UNION ALL SELECT src, dst, true FROM plain p WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gold g WHERE (g.src = p.src AND g.dst = p.dst) OR (g.src = p.dst AND g.dst = p.src))""")
def distractor_edges(spark: SparkSession, sf: str) -> DataFrame:
    r = R.ratings(spark, sf)
    gold = corpus.consecutive_edges(r.filter("a"), "source", "doc_id")
    return corpus.with_distractors(gold, corpus.consecutive_edges(r.filter("not a"), "source", "doc_id"))


# --- vectors ----------------------------------------------------------------------------------------------------------


@query(f"WITH {R.SQL_HITS} SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(R.questions(spark, sf), R.vectors_of(spark, sf), 10)


@query(f"""WITH {R.SQL_HITS}, f AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM hits WHERE tag = qtag)
SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10""")
def top_k_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(R.questions(spark, sf), R.vectors_of(spark, sf), 10, match=True)


SQL_RERANK = f"""{R.SQL_HITS}, {R.SQL_CHUNKS},
top AS (SELECT r.query_id, r.id, r.rank AS found, c.module, c.heading, c.full_text, c.object_type FROM ranked r JOIN chunks c USING (id) WHERE r.rank <= 10),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(heading) DESC, id) AS pos FROM top)"""


@query(f"WITH {SQL_RERANK} SELECT query_id, id, CAST(found AS INTEGER) AS found, CAST(pos AS INTEGER) AS rank FROM best WHERE pos <= 5")
def vanilla_context(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest, reranked (by heading length, in place of a model), five kept."""
    hits = top_k(spark, sf).withColumnRenamed("rank", "found").join(R.chunks(spark, sf).select("id", "heading"), "id")
    return vectors.rerank(hits, F.length("heading"), 5).select("query_id", "id", "found", "rank")


@query(f"""WITH {R.SQL_EDGES}, {R.SQL_SEEDS}, {R.SQL_WALK},
sim AS (SELECT w.query_id, w.id, round(1 - h.distance, 6) AS score FROM walk w JOIN hits h ON h.query_id = w.query_id AND h.id = w.id WHERE w.rank <= 30),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 5""")
def rerank_walked(spark: SparkSession, sf: str) -> DataFrame:
    """Of the nodes that a walk finds, the five most similar to the question."""
    w = graph.walk_2hop(R.seeds(spark, sf), R.edges(spark, sf)).select("query_id", "id")
    q, v = R.questions(spark, sf).select("query_id", F.col("vector").alias("qv")), R.vectors_of(spark, sf).select("id", "vector")
    return vectors.rerank(w.join(q, "query_id").join(v, "id"), r6(vectors.cosine(F.col("qv"), F.col("vector"))), 5).select("query_id", "id", "score", "rank")


@query("SELECT vec_id, CASE WHEN label = 3 THEN 103 ELSE label END AS label, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings UNION ALL SELECT vec_id + 1000000000, label, CAST(len(embedding) AS INTEGER) FROM embeddings WHERE label = 4")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of vectors with some rows changed and some added, every change given twice."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    changes = e.filter("label = 3").withColumn("label", F.lit(103)).union(e.filter("label = 4").select(F.col("vec_id") + 1000000000, "label", "embedding"))
    t = KeyedTable.create(e, folder(spark, "vectors"), ["vec_id"], vector="embedding")
    t.upsert(changes.union(changes))
    return t.read().select("vec_id", "label", F.size("embedding").alias("dims"))


@query(f"WITH {R.SQL_HITS} SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def index_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of top_k out of a stored index: near cells first, then those that could hold a nearer vector."""
    index, _ = VectorIndex.build(R.vectors_of(spark, sf), folder(spark, "index"))
    return index.search(R.questions(spark, sf), 10, exact=True)


@query(ORACLES["top_k_filtered"])
def index_top_k_filtered(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = VectorIndex.build(R.vectors_of(spark, sf), folder(spark, "index"))
    return index.search(R.questions(spark, sf), 10, match=True, exact=True)


# --- graph ------------------------------------------------------------------------------------------------------------


@query(f"WITH {R.SQL_EDGES}, {R.SQL_SEEDS}, {R.SQL_WALK} SELECT query_id, id, hops, CAST(rank AS INTEGER) AS rank FROM walk WHERE rank <= 30")
def walk_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.walk_2hop(R.seeds(spark, sf), R.edges(spark, sf))


@query(f"""WITH {R.SQL_EDGES}, {R.SQL_SEEDS}
SELECT query_id, s.id AS seed, dst AS id, 'out' AS dir, rel FROM seeds s JOIN walkable ON src = s.id
UNION SELECT query_id, s.id, src, 'in', rel FROM seeds s JOIN walkable ON dst = s.id""")
def hop1_directed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hop1_directed(R.seeds(spark, sf), R.edges(spark, sf))


@query(f"""WITH {R.SQL_EDGES} SELECT w.src, w.dst, w.rel, a.module AS src_module, b.module AS dst_module
FROM walkable w JOIN chunks a ON a.id = w.src JOIN chunks b ON b.id = w.dst WHERE w.src <> w.dst""")
def edges_with_ends(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges_with_ends(R.edges(spark, sf), R.chunks(spark, sf))


SQL_PATHS2 = f"""{R.SQL_EDGES}, e AS (SELECT *, row_number() OVER (ORDER BY src, dst, rel) AS eid FROM walkable),
paths2 AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.rel AS r1, y.rel AS r2 FROM e x JOIN e y ON x.dst = y.src WHERE x.eid <> y.eid AND x.src <> y.dst)"""


@query(f"WITH {SQL_PATHS2} SELECT a || '>' || b || '>' || c AS nodes, r1 || '>' || r2 AS rels, 2 AS hops FROM paths2")
def paths_2hop(spark: SparkSession, sf: str) -> DataFrame:
    p = graph.paths(R.edges(spark, sf), 2, 2)
    return p.select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "hops")


@query(f"""WITH {R.SQL_EDGES}, e AS (SELECT *, row_number() OVER (ORDER BY src, dst, rel) AS eid FROM walkable),
p3 AS (SELECT x.src AS a, z.dst AS d, x.src || '>' || x.dst || '>' || y.dst || '>' || z.dst AS nodes, x.rel || '>' || y.rel || '>' || z.rel AS rels, x.eid AS e1, y.eid AS e2, z.eid AS e3
       FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src WHERE x.eid <> y.eid AND z.eid NOT IN (x.eid, y.eid)),
p4 AS (SELECT p3.a, w.dst AS d, nodes || '>' || w.dst AS nodes, rels || '>' || w.rel AS rels FROM p3 JOIN e w ON p3.d = w.src WHERE w.eid NOT IN (e1, e2, e3))
SELECT nodes, rels, 3 AS hops FROM p3 WHERE a <> d UNION ALL SELECT nodes, rels, 4 FROM p4 WHERE a <> d""")
def paths_3_4hop(spark: SparkSession, sf: str) -> DataFrame:
    p = graph.paths(R.edges(spark, sf), 3, 4)
    return p.select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "hops")


@query(f"""WITH {SQL_PATHS2},
s AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || a || '>' || b || '>' || c || '|' || r1 || '>' || r2), a, b, c, r1, r2) AS k FROM paths2)
SELECT a AS source_id, c AS target_id, 2 AS hop_count, a || '>' || b || '>' || c AS expected_ids, x.module <> y.module AS is_cross_module
FROM s JOIN chunks x ON x.id = a JOIN chunks y ON y.id = c WHERE k <= 25""")
def chain_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Gold records of 25 chains in seeded order."""
    p = graph.paths(R.edges(spark, sf), 2, 2).withColumn("n", F.array_join(F.col("nodes").cast("array<string>"), ">")).withColumn("r", F.array_join("rels", ">"))
    s = p.withColumn("o", runs.seeded_order("n", "r", seed=7)).orderBy("o", "n", "r").limit(25)
    g = graph.gold_records(s, R.chunks(spark, sf))
    return g.select("source_id", "target_id", "hop_count", F.array_join(F.col("expected_ids").cast("array<string>"), ">").alias("expected_ids"), "is_cross_module")


@query(f"WITH {R.SQL_EDGES}, {R.SQL_SEEDS}, {R.sql_ppr()} SELECT query_id, id, round(score, 6) AS score FROM ppr WHERE rank <= 30")
def personalized_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return graph.walk_ppr(R.seeds(spark, sf), R.edges(spark, sf)).select("query_id", "id", r6("score").alias("score"))


# --- retrieval --------------------------------------------------------------------------------------------------------


def sql_context(extra: str, walk_cap: int, cap: int) -> str:
    return f"""merged AS (SELECT query_id, id, 0 AS hops, 0 AS part, rank FROM seeds
    UNION ALL SELECT query_id, id, hops, 1, rank FROM {extra} WHERE rank <= {walk_cap} AND id IN (SELECT id FROM chunks)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, id) AS pos FROM merged),
  context AS (SELECT o.query_id, o.id, o.hops, o.pos, c.module, c.heading, c.full_text FROM ordered o JOIN chunks c USING (id) WHERE pos <= {cap})"""


SQL_RAG = f"{R.SQL_EDGES}, {R.SQL_SEEDS}, {R.SQL_WALK}, {sql_context('walk', 30, 15)}"


@query(f"WITH {SQL_RAG} SELECT query_id, id, hops, CAST(pos AS INTEGER) AS pos, module, heading FROM context")
def graphrag_context(spark: SparkSession, sf: str) -> DataFrame:
    c = retrieval.graphrag(R.seeds(spark, sf), R.edges(spark, sf), R.chunks(spark, sf))
    return c.select("query_id", "id", "hops", "pos", "module", "heading")


@query(f"WITH {R.SQL_EDGES}, {R.SQL_SEEDS}, {R.SQL_WALK}, {sql_context('walk', 10, 8)} SELECT query_id, id, CAST(pos AS INTEGER) AS pos FROM context")
def budget_cap_context(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.graphrag(R.seeds(spark, sf), R.edges(spark, sf), R.chunks(spark, sf), 10, 8).select("query_id", "id", "pos")


SQL_PPR_CONTEXT = f"{R.SQL_EDGES}, {R.SQL_SEEDS}, {R.sql_ppr()}, p AS (SELECT query_id, id, 1 AS hops, rank FROM ppr), {sql_context('p', 30, 15)}"


@query(f"WITH {SQL_PPR_CONTEXT} SELECT query_id, id, CAST(pos AS INTEGER) AS pos FROM context")
def ppr_context(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.graphrag(R.seeds(spark, sf), R.edges(spark, sf), R.chunks(spark, sf), ppr=True).select("query_id", "id", "pos")


@query(f"""WITH {SQL_RAG}, w AS (SELECT query_id, id FROM context), v AS (SELECT query_id, id FROM ranked JOIN chunks USING (id) WHERE rank <= 10),
n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1), m AS (SELECT query_id, count(*) AS m FROM v GROUP BY 1), i AS (SELECT query_id, count(*) AS i FROM w JOIN v USING (query_id, id) GROUP BY 1)
SELECT query_id, CAST(n AS INTEGER) AS n_walk, CAST(m AS INTEGER) AS n_vector, round(coalesce(i, 0) / greatest(1, n + m - coalesce(i, 0)), 6) AS jaccard,
       (SELECT count(*) FROM seeds s WHERE s.query_id = n.query_id AND s.id IN (SELECT id FROM chunks) AND NOT EXISTS (SELECT 1 FROM w WHERE w.query_id = s.query_id AND w.id = s.id)) = 0 AS seeds_inside
FROM n JOIN m USING (query_id) LEFT JOIN i USING (query_id)""")
def context_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Graph contexts against vector contexts of the same questions, and whether the seeds are inside."""
    ch = R.chunks(spark, sf).select("id")
    w = graphrag_context(spark, sf).groupBy("query_id").agg(F.collect_set("id").alias("w"))
    v = top_k(spark, sf).join(ch, "id").groupBy("query_id").agg(F.collect_set("id").alias("v"))
    s = R.seeds(spark, sf).join(ch, "id").groupBy("query_id").agg(F.collect_set("id").alias("s"))
    return w.join(v, "query_id").join(s, "query_id", "left").select("query_id", F.size("w").alias("n_walk"), F.size("v").alias("n_vector"), r6(metrics.jaccard(F.col("w"), F.col("v"))).alias("jaccard"), F.coalesce(F.size(F.array_except("s", "w")) == 0, F.lit(True)).alias("seeds_inside"))


@query(f"""WITH {SQL_RAG} SELECT query_id, string_agg('[' || id || '] (' || module || ' :: ' || heading || ')' || chr(10) || full_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS prompt
FROM context GROUP BY query_id""")
def context_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.formatted(retrieval.graphrag(R.seeds(spark, sf), R.edges(spark, sf), R.chunks(spark, sf))).select("query_id", "prompt")


SQL_NEAR1 = f"""{R.SQL_EDGES}, {R.SQL_SEEDS},
near1 AS (SELECT query_id, s.id AS seed, rank AS pos, dst AS id, 0 AS d, rel, 'out' AS dir FROM seeds s JOIN walkable ON src = s.id
          UNION SELECT query_id, s.id, rank, src, 1, rel, 'in' FROM seeds s JOIN walkable ON dst = s.id)"""


@query(f"""WITH {SQL_NEAR1},
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pos, d, rel) AS k FROM near1 n WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = n.query_id AND s.id = n.id))
SELECT query_id, id, 0 AS hops, NULL AS rel, NULL AS dir FROM seeds WHERE id IN (SELECT id FROM chunks)
UNION ALL SELECT query_id, id, 1, rel, dir FROM f WHERE k = 1 AND id IN (SELECT id FROM chunks)""")
def graph_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.graph_id_lookup(R.seeds(spark, sf).withColumnRenamed("rank", "pos"), R.edges(spark, sf), R.chunks(spark, sf))


@query(f"""WITH {SQL_NEAR1},
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, seed, id ORDER BY d, rel) AS k FROM near1),
t AS (SELECT query_id, seed, 'Found ' || count(*) || ' requirement(s) linked to ' || seed || ':' || chr(10) || string_agg('  ' || seed || ' ' || CASE dir WHEN 'out' THEN '-->' ELSE '<--' END || '[:' || rel || ']' || CASE dir WHEN 'out' THEN '-->' ELSE '<--' END || ' [' || f.id || '] (' || substring(heading, 1, 50) || ')', chr(10) ORDER BY d, f.id) AS summary
      FROM f JOIN chunks c ON c.id = f.id WHERE k = 1 GROUP BY query_id, seed)
SELECT s.query_id, s.id AS seed, coalesce(summary, 'No traceability links found involving ' || s.id || '.') AS summary FROM seeds s LEFT JOIN t ON t.query_id = s.query_id AND t.seed = s.id""")
def graph_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.graph_lookup(R.seeds(spark, sf), R.edges(spark, sf), R.chunks(spark, sf))


# --- text and routing -------------------------------------------------------------------------------------------------


def _questions_text(spark: SparkSession, sf: str) -> DataFrame:
    """User turns, some with an identifier, module names or routing words in front."""
    t = table(spark, sf, "conversations").filter("role = 'user'")
    front = F.array(*(F.lit(x) for x in ("What does ADS-014 specify about ", "How does NAV feed FCC? ", "Which trace verifies SW-12 and REQ-7: ", "ADS latency: ", "", "DO-178C FCC-022 ADS-014 ")))
    return t.select("conv_id", "turn", F.concat(F.get(front, ((F.col("conv_id") + F.col("turn")) % 6).cast("int")), "text").alias("query"))


SQL_ASKED = """asked AS (SELECT conv_id, turn, ['What does ADS-014 specify about ', 'How does NAV feed FCC? ', 'Which trace verifies SW-12 and REQ-7: ', 'ADS latency: ', '', 'DO-178C FCC-022 ADS-014 '][(conv_id + turn) % 6 + 1] || text AS query
  FROM conversations WHERE role = 'user')"""


def _sql_any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + ")"


SQL_V1 = f"""{SQL_ASKED},
f AS (SELECT *, len(list_distinct(regexp_extract_all(query, '\\b([A-Z]{{2,5}}-\\d+)\\b', 1))) AS n_ids,
        len(list_distinct(list_filter(regexp_extract_all(regexp_replace(query, '\\b([A-Z]{{2,5}}-\\d+)\\b', '', 'g'), '\\b([A-Z]{{2,5}})\\b', 1), lambda m: list_contains([{R._in(text.MODULES)}], m)))) AS n_modules,
        {_sql_any(text.TRACE_WORDS)} AS has_trace, {_sql_any(text.CHAIN_WORDS)} AS has_chain, {_sql_any(text.NUMERIC_WORDS)} AS has_numeric FROM asked),
routed AS (SELECT *, CASE WHEN n_ids >= 1 AND has_trace THEN 'R1' WHEN n_ids >= 1 THEN 'R2' WHEN n_modules >= 2 AND has_chain THEN 'R3' WHEN has_trace THEN 'R4' WHEN has_numeric AND n_modules = 1 THEN 'R5' ELSE 'default' END AS rule FROM f)"""


@query(f"""WITH {SQL_V1} SELECT conv_id, turn, CAST(n_ids AS INTEGER) AS n_ids, CAST(n_modules AS INTEGER) AS n_modules, has_trace, has_chain, has_numeric, rule,
CASE rule WHEN 'R1' THEN 'agentic-graph' WHEN 'R2' THEN 'vanilla' WHEN 'R3' THEN 'graphrag' WHEN 'R4' THEN 'graphrag' WHEN 'R5' THEN 'vanilla' ELSE 'agentic' END AS pipeline FROM routed""")
def router_v1(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route_v1(_questions_text(spark, sf)).select("conv_id", "turn", "n_ids", "n_modules", "has_trace", "has_chain", "has_numeric", "rule", "pipeline")


@query(f"""WITH {SQL_ASKED} SELECT conv_id, turn, CAST(len(regexp_extract_all(query, '(?i)\\b(REQ|SRS|HLR|LLR|SW)-\\d+\\b')) AS INTEGER) AS entity_count,
CASE WHEN regexp_matches(query, '(?i)\\b(REQ|SRS|HLR|LLR|SW)-\\d+\\b') THEN 1 ELSE 0 END AS has_id_regex,
round(ln(1 + len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> ''))), 6) AS query_token_len_log,
{", ".join(f"CASE WHEN contains(lower(query), '{w}') THEN 1 ELSE 0 END AS {k}" for k, w in text.KEYWORDS_V2.items())} FROM asked""")
def text_features_v2(spark: SparkSession, sf: str) -> DataFrame:
    f = text.features_v2(F.col("query"))
    f["query_token_len_log"] = r6(f["query_token_len_log"])
    return _questions_text(spark, sf).select("conv_id", "turn", *(v.alias(k) for k, v in f.items()))


@query(f"""WITH {SQL_ASKED}, x AS (SELECT conv_id, turn, regexp_extract_all(query, '\\b([A-Z]{{2,5}}-(?:[A-Z]?\\d+))\\b', 1) AS a FROM asked)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(a)), ';') AS ids FROM x""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return _questions_text(spark, sf).select("conv_id", "turn", F.array_join(F.sort_array(text.ids_in(F.col("query"))), ";").alias("ids"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.upper(F.regexp_replace("p_brand", "#", "-"))
    return table(spark, sf, "part").select("p_partkey", brand.alias("brand"), F.concat(F.lit("See "), brand, F.lit(", BRAND-"), F.col("p_size").cast("string"), F.lit(" and SHA-256, again "), brand, F.lit(".")).alias("answer"))


@query("""
WITH p AS (SELECT p_partkey, upper(replace(p_brand, '#', '-')) AS brand, p_size FROM part), v AS (SELECT DISTINCT brand FROM p),
x AS (SELECT p_partkey, brand, 'BRAND-' || p_size AS other FROM p)
SELECT p_partkey, CASE WHEN other IN (SELECT brand FROM v) AND other <> brand THEN brand || ';' || other ELSE brand END AS cited,
       CASE WHEN other IN (SELECT brand FROM v) THEN '' ELSE other END AS invented FROM x""")
def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Citations against the table of known identifiers (the brands), with invented ones."""
    a = _answers(spark, sf)
    c = citing.citations(a, a.select(F.col("brand").alias("id")), "p_partkey", "answer")
    return c.select("p_partkey", *(F.array_join(k, ";").alias(k) for k in ("cited", "invented")))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, 'sufficient' AS verdict FROM events")
def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """JSON out of text around it; a critic's verdict that isn't there counts as sufficient."""
    raw = F.concat(F.lit("Here: ```"), "props", F.lit("``` as asked"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(text.first_json(raw), "$.k").cast("long").alias("k"), text.critic_verdict(raw).alias("verdict"))


SQL_WIDE = f"""{R.SQL_MEANS},
wide AS (SELECT query_id, stratum, {", ".join(f"max(CASE WHEN pipeline = '{e}' THEN score END) AS {e}" for e in R.EVENTS)} FROM means GROUP BY 1, 2)"""


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return routing.wide_scores(R.scored(spark, sf), ["query_id", "stratum"], R.EVENTS)


SQL_ORACLE = f"""{SQL_WIDE},
orc AS (SELECT *, greatest(click, error, purchase, signup) AS oracle_score FROM wide WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL),
picked AS (SELECT *, CASE WHEN click = oracle_score THEN 'click' WHEN error = oracle_score THEN 'error' WHEN purchase = oracle_score THEN 'purchase' ELSE 'signup' END AS oracle_pipeline FROM orc)"""


@query(f"WITH {SQL_ORACLE} SELECT query_id, stratum, oracle_pipeline, round(oracle_score, 6) AS oracle_score FROM picked")
def oracle_route(spark: SparkSession, sf: str) -> DataFrame:
    return routing.oracle_route(_wide(spark, sf), R.EVENTS[:4]).select("query_id", "stratum", "oracle_pipeline", r6("oracle_score").alias("oracle_score"))


@query(f"""WITH {SQL_ORACLE},
x AS (SELECT stratum, oracle_score, click AS base, CASE stratum WHEN '1-hop' THEN click WHEN '2-hop' THEN purchase ELSE signup END AS routed FROM picked),
g AS (SELECT stratum, count(*) AS n, avg(routed) AS routed, avg(base) AS base, avg(oracle_score) AS oracle FROM x GROUP BY ROLLUP (stratum))
SELECT stratum, n, round(routed, 6) AS routed, round(base, 6) AS base, round(oracle, 6) AS oracle, round(CASE WHEN oracle > base THEN (routed - base) / (oracle - base) WHEN routed > base THEN 'infinity'::DOUBLE ELSE 0.0 END, 6) AS gap_closed FROM g""")
def adaptive_compare(spark: SparkSession, sf: str) -> DataFrame:
    """A route by stratum against the best fixed pipeline's gap to the oracle."""
    o = routing.oracle_route(_wide(spark, sf), R.EVENTS[:4])
    scores = o.select("query_id", F.explode(F.array(*(F.struct(F.lit(e).alias("pipeline"), F.col(e).alias("score")) for e in R.EVENTS[:4]))).alias("s")).select("query_id", "s.*")
    to = F.when(F.col("stratum") == "1-hop", "click").when(F.col("stratum") == "2-hop", "purchase").otherwise("signup")
    g = routing.adaptive_compare(o.select("query_id", "stratum", to.alias("pipeline")), scores, o.withColumn("base_score", F.col("click")), ["stratum"])
    return g.select("stratum", "n", *(r6(c).alias(c) for c in ("routed", "base", "oracle", "gap_closed")))


@query(f"""WITH {SQL_ORACLE} SELECT stratum, oracle_pipeline, count(*) AS n, round(avg(oracle_score), 6) AS mean_score FROM picked GROUP BY 1, 2""")
def oracle_distribution(spark: SparkSession, sf: str) -> DataFrame:
    o = routing.oracle_route(_wide(spark, sf), R.EVENTS[:4])
    return o.groupBy("stratum", "oracle_pipeline").agg(F.count("*").alias("n"), r6(F.avg("oracle_score")).alias("mean_score"))


def _routable(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 4, "vanilla").when(F.col("label") < 7, "graphrag").otherwise("agentic-graph").alias("target"))
    q = e.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("query")), "vec_id", "left")
    return router_model.features(q, "query", "embedding")


@query()
def router_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold routes of the learned router (ten folds); its target is the class of the question's vector."""
    return router_model.out_of_fold(_routable(spark, sf), "target", "vec_id")


@query()
def router_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Macro-F1 of the learned router in five times ten folds."""
    return router_model.cross_validation(_routable(spark, sf), "target", "vec_id")


# --- agreement --------------------------------------------------------------------------------------------------------

_CONF = "count(*) FILTER (WHERE a AND b) AS tt, count(*) FILTER (WHERE a AND NOT b) AS tf, count(*) FILTER (WHERE NOT a AND b) AS ft, count(*) FILTER (WHERE NOT a AND NOT b) AS ff"


@query(f"WITH {R.SQL_RATINGS} SELECT lang, {_CONF} FROM ratings GROUP BY lang")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.confusion(R.ratings(spark, sf), ["lang"])


@query(f"""WITH {R.SQL_RATINGS}, c AS (SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, {_CONF} FROM ratings GROUP BY GROUPING SETS ((lang), (source), ())),
n AS (SELECT *, CAST(tt + tf + ft + ff AS DOUBLE) AS n, (tt + tf) / (tt + tf + ft + ff) AS pa, (tt + ft) / (tt + tf + ft + ff) AS pb, (2 * tt + tf + ft) / (2 * (tt + tf + ft + ff)) AS pi FROM c)
SELECT lang, source, level, CAST(n AS BIGINT) AS n, round((tt + ff) / n, 6) AS raw_agreement,
       round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN ((tt + ff) / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa,
       round(((tt + ff) / n - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi)), 6) AS ac1 FROM n""")
def grouping_sets_agreement(spark: SparkSession, sf: str) -> DataFrame:
    c = agreement.agreement(agreement.confusion(R.ratings(spark, sf), ["lang", "source"], sets=[["lang"], ["source"], []]))
    return c.select("lang", "source", "level", "n", *(r6(k).alias(k) for k in ("raw_agreement", "kappa", "ac1")))


@query(f"""WITH {R.SQL_RATINGS}, l AS (SELECT lang, doc_id, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(n_chars > 1000 AS INTEGER) AS yes FROM ratings),
k AS (SELECT lang, count(*) AS n_items, avg((yes * (yes - 1) + (3 - yes) * (2 - yes)) / 6) AS p_bar, sum(yes) / (3 * count(*)) AS p FROM l GROUP BY lang)
SELECT lang, n_items, 3 AS n_raters, round(CASE WHEN p * p + (1 - p) * (1 - p) < 1 THEN (p_bar - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))) END, 6) AS fleiss_kappa FROM k""")
def fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    r = R.ratings(spark, sf).select("lang", F.col("doc_id").alias("item"), F.explode(F.array("a", "b", F.col("n_chars") > 1000)).alias("rating"))
    return agreement.fleiss(r, keys=("lang",)).select("lang", "n_items", F.col("n_raters").cast("int").alias("n_raters"), r6("fleiss_kappa").alias("fleiss_kappa"))


SQL_MCNEMAR = f"""{R.SQL_RATINGS}, c AS (SELECT source, {_CONF} FROM ratings GROUP BY source),
m AS (SELECT source, tf AS b, ft AS c, least(1.0, 2 * (SELECT sum(exp(lgamma(tf + ft + 1) - lgamma(i + 1) - lgamma(tf + ft - i + 1) - (tf + ft) * ln(2))) FROM generate_series(0, least(tf, ft)) t(i))) AS p FROM c WHERE tf + ft > 0
      UNION ALL SELECT source, tf, ft, NULL FROM c WHERE tf + ft = 0)"""


@query(f"WITH {SQL_MCNEMAR} SELECT source, b, c, round(p, 6) AS p FROM m")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    c = agreement.confusion(R.ratings(spark, sf), ["source"])
    return c.select("source", F.col("tf").alias("b"), F.col("ft").alias("c"), r6(stats.mcnemar_p(F.col("tf"), F.col("ft"))).alias("p"))


@query(f"""WITH {SQL_MCNEMAR}, v AS (SELECT source, round(p, 6) AS p FROM m), r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS k, count(*) OVER () AS f FROM v WHERE p IS NOT NULL)
SELECT source, p, round(least(1.0, max((f - k + 1) * p) OVER (ORDER BY k)), 6) AS holm_p, f AS family_size FROM r
UNION ALL SELECT source, NULL, NULL, (SELECT count(*) FROM v WHERE p IS NOT NULL) FROM v WHERE p IS NULL""")
def holm_correction(spark: SparkSession, sf: str) -> DataFrame:
    return significance.holm(mcnemar(spark, sf).select("source", "p")).select("source", "p", r6("holm_p").alias("holm_p"), "family_size")


@query(f"""WITH {R.SQL_RATINGS}, c AS (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE a) AS faithful FROM ratings GROUP BY 1, 2), z AS (SELECT *, faithful / n AS s, 1.959964 AS z FROM c)
SELECT source, lang, n, faithful, round(s, 6) AS share, round(greatest(0.0, ((s + z * z / (2 * n)) - z * sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS wilson_lo,
       round(least(1.0, ((s + z * z / (2 * n)) + z * sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS wilson_hi FROM z""")
def wilson_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = agreement.share_cells(R.ratings(spark, sf), ["source", "lang"], "a")
    return c.select("source", "lang", "n", "faithful", *(r6(k).alias(k) for k in ("share", "wilson_lo", "wilson_hi")))


_TREND_ORDER = ("de", "en", "es", "fr")
SQL_TREND = f"""{R.SQL_RATINGS}, c AS (SELECT source, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS w, count(*) AS n, count(*) FILTER (WHERE a) AS x FROM ratings GROUP BY 1, 2),
t AS (SELECT source, sum(n) AS n, sum(x) AS x, sum(w * n) AS s1, sum(w * w * n) AS s2, sum(w * x) AS wx, coalesce(sum(x) FILTER (WHERE w = 0), 0) AS a, coalesce(sum(n - x) FILTER (WHERE w = 0), 0) AS b,
             coalesce(sum(x) FILTER (WHERE w = 3), 0) AS c, coalesce(sum(n - x) FILTER (WHERE w = 3), 0) AS d FROM c GROUP BY source),
h AS (SELECT source, i, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp, i = a AS mine
      FROM t, LATERAL (SELECT unnest(generate_series(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT))) AS i) s),
f AS (SELECT h.source, least(1.0, sum(exp(h.lp))) AS p FROM h JOIN (SELECT source, lp FROM h WHERE mine) o ON o.source = h.source AND h.lp <= o.lp + 1e-7 GROUP BY 1)"""


@query(f"""WITH {SQL_TREND} SELECT t.source, CASE WHEN x > 0 AND x < n AND s2 - s1 * s1 / n > 0 THEN round((wx - s1 * x / n) / sqrt(x / n * (1 - x / n) * (s2 - s1 * s1 / n)), 6) END AS trend_z,
CASE WHEN a + b + c + d > 0 THEN round(f.p, 6) END AS fisher_p FROM t LEFT JOIN f USING (source)""")
def trend_and_fisher(spark: SparkSession, sf: str) -> DataFrame:
    t = agreement.trend(R.ratings(spark, sf), ["source"], "lang", list(_TREND_ORDER), "a")
    return t.select("source", r6("trend_z").alias("trend_z"), r6("fisher_p").alias("fisher_p"))


@query(f"""WITH {R.SQL_RATINGS}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS rb FROM ratings)
SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 AND min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 6) END AS spearman_rho FROM r GROUP BY lang""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    x = R.ratings(spark, sf).select("lang", "n_chars", F.col("a").cast("int").alias("q"))
    return agreement.spearman(x, "n_chars", "q", ["lang"]).select("lang", "n", r6("spearman_rho").alias("spearman_rho"))


@query(f"""WITH {R.SQL_MEANS}, c AS (SELECT pipeline, stratum, avg(score) AS m FROM means GROUP BY 1, 2), d AS (SELECT *, m - lag(m) OVER (PARTITION BY pipeline ORDER BY stratum) AS d FROM c)
SELECT pipeline, count(*) AS n_cells, coalesce(bool_and(d <= 0), true) AS never_rises, coalesce(bool_and(d >= 0), true) AS never_falls FROM d GROUP BY pipeline""")
def monotone_strata(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.monotone(_cells(spark, sf), ["pipeline"], "stratum", "mean_score")


# --- significance -----------------------------------------------------------------------------------------------------


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return R.scored(spark, sf).groupBy("query_id", "stratum", "pipeline").agg(F.avg("score").alias("score"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).groupBy("pipeline", "stratum").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return significance.pairs_long(_wide(spark, sf), ["query_id", "stratum"], R.EVENTS)


@query(f"WITH {R.SQL_MEANS} SELECT query_id, stratum, pipeline, round(score, 6) AS score FROM means")
def per_query_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).withColumn("score", r6("score"))


@query(f"WITH {R.SQL_MEANS} SELECT pipeline, stratum, count(*) AS n, round(avg(score), 6) AS mean_score FROM means GROUP BY ROLLUP (pipeline, stratum)")
def mean_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).rollup("pipeline", "stratum").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"))


@query(f"""WITH {R.SQL_MEANS}, c AS (SELECT stratum, pipeline, avg(score) AS m FROM means GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY m DESC, pipeline) AS k FROM c)
SELECT stratum, pipeline AS winner, round(m, 6) AS best FROM k WHERE k = 1""")
def stratum_winners(spark: SparkSession, sf: str) -> DataFrame:
    return runs.winners(_cells(spark, sf), ["stratum"], "mean_score", "pipeline").select("stratum", "winner", r6("best").alias("best"))


_GRID = ", ".join(f"('{s}')" for s in (*STRATA, "4-hop"))


@query(f"""WITH {R.SQL_MEANS}, g AS (SELECT * FROM (VALUES {_GRID}) s(stratum) CROSS JOIN (VALUES {", ".join(f"('{e}')" for e in R.EVENTS)}) p(pipeline))
SELECT g.stratum, g.pipeline, count(m.score) AS n, round(avg(m.score), 6) AS mean_score FROM g LEFT JOIN means m ON m.stratum = g.stratum AND m.pipeline = g.pipeline GROUP BY 1, 2""")
def complete_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every stratum with every pipeline; a cell without rows has n 0 and no mean."""
    grid = spark.createDataFrame([(s, p) for s in (*STRATA, "4-hop") for p in R.EVENTS], "stratum string, pipeline string")
    return grid.join(_cells(spark, sf), ["stratum", "pipeline"], "left").select("stratum", "pipeline", F.coalesce("n", F.lit(0)).alias("n"), r6("mean_score").alias("mean_score"))


@query(f"WITH {R.SQL_MEANS} SELECT stratum, pipeline_i, pipeline_j, count(*) AS n_paired, round(avg(x - y), 6) AS mean_delta FROM pairs GROUP BY 1, 2, 3")
def pairwise_delta(spark: SparkSession, sf: str) -> DataFrame:
    return significance.pairwise_delta(_pairs(spark, sf), ["stratum"]).withColumn("mean_delta", r6("mean_delta"))


@query(f"""WITH {R.SQL_MEANS}, d AS (SELECT stratum, pipeline_i, pipeline_j, round(x - y, 9) AS d FROM pairs),
n AS (SELECT stratum, pipeline_i, pipeline_j, count(*) AS n_paired FROM d GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY stratum, pipeline_i, pipeline_j, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY stratum, pipeline_i, pipeline_j, abs(d)) AS t FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY stratum, pipeline_i, pipeline_j ORDER BY abs(d))),
s AS (SELECT stratum, pipeline_i, pipeline_j, count(*) AS m, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(t * t - 1) AS t FROM r GROUP BY 1, 2, 3)
SELECT stratum, pipeline_i, pipeline_j, n_paired, coalesce(m, 0) AS n_nonzero, round(w_plus, 6) AS w_plus,
       CASE WHEN n_paired >= 2 AND m * (m + 1) * (2 * m + 1) / 24 - t / 48 > 0 THEN round((w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - t / 48), 6) END AS z
FROM n LEFT JOIN s USING (stratum, pipeline_i, pipeline_j)""")
def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    w = significance.wilcoxon(_pairs(spark, sf), ["stratum"])
    return w.select("stratum", "pipeline_i", "pipeline_j", "n_paired", "n_nonzero", r6("w_plus").alias("w_plus"), r6("z").alias("z"))


@query(f"""WITH {R.SQL_MEANS}, d AS (SELECT a.stratum, a.pipeline AS pipeline_i, b.pipeline AS pipeline_j, avg(sign(a.score - b.score)) AS delta FROM means a JOIN means b ON a.stratum = b.stratum AND a.pipeline < b.pipeline GROUP BY 1, 2, 3)
SELECT stratum, pipeline_i, pipeline_j, round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM d""")
def cliffs_delta(spark: SparkSession, sf: str) -> DataFrame:
    return significance.cliffs_delta(_pairs(spark, sf), ["stratum"]).select("stratum", "pipeline_i", "pipeline_j", r6("delta").alias("delta"), "magnitude")


@query()
def bca_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """BCa intervals of mean scores per stratum and pipeline."""
    return significance.bca_mean(_means(spark, sf), ["stratum", "pipeline"], "score", ["query_id"])


# --- runs -------------------------------------------------------------------------------------------------------------


@query("""
WITH c(pipeline, reranker) AS (VALUES ('vanilla', NULL), ('vanilla', 'local'), ('vanilla', 'remote'), ('agentic', NULL), ('graphrag', NULL), ('agentic-graph', NULL), ('adaptive', NULL))
SELECT vec_id AS query_id, repeat, pipeline, embedder, reranker FROM embeddings, c, (VALUES ('local'), ('bge')) e(embedder), (VALUES (0), (1), (2)) r(repeat) WHERE vec_id % 100 = 0""")
def config_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return runs.matrix(R.questions(spark, sf).select("query_id"), runs.configs(spark, ["local", "bge"]), 3)


@query(f"""WITH {R.SQL_RUNS}, u AS (SELECT DISTINCT query FROM runs), p AS (SELECT query, pipeline, repeat FROM u, (VALUES {", ".join(f"('{e}')" for e in R.EVENTS)}) e(pipeline), (VALUES (0), (1)) r(repeat))
SELECT query, pipeline, repeat FROM p WHERE NOT (repeat = 0 AND EXISTS (SELECT 1 FROM runs r WHERE r.query = p.query AND r.pipeline = p.pipeline))""")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    log = R.run_log(spark, sf).select("query", "pipeline", F.lit(0).alias("repeat"))
    cells = F.array(*(F.lit(e) for e in R.EVENTS))
    planned = log.select("query").distinct().withColumn("pipeline", F.explode(cells)).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
    return runs.pending(planned, log, ["query", "pipeline", "repeat"])


@query(f"""WITH {R.SQL_RUNS} SELECT pipeline, count(*) AS n, count(*) FILTER (WHERE latency_ms >= 0) AS ok, round(coalesce(sum(latency_ms) FILTER (WHERE latency_ms >= 0), 0) / greatest(count(*) FILTER (WHERE latency_ms >= 0), 1), 6) AS avg_ms,
round(coalesce(sum(total_tokens) FILTER (WHERE latency_ms >= 0), 0) / greatest(count(*) FILTER (WHERE latency_ms >= 0), 1), 6) AS avg_tokens, round(coalesce(sum(n_cited) FILTER (WHERE latency_ms >= 0), 0) / greatest(count(*) FILTER (WHERE latency_ms >= 0), 1), 6) AS avg_cited FROM runs GROUP BY pipeline""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = runs.summary(R.run_log(spark, sf), ["pipeline"])
    return s.select("pipeline", "n", "ok", *(r6(c).alias(c) for c in ("avg_ms", "avg_tokens", "avg_cited")))


@query(f"""WITH {R.SQL_SCORED}, o AS (SELECT *, md5('5|' || event_id) AS o FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY o, event_id) AS k FROM o)
SELECT event_id, pipeline FROM k WHERE k <= 20 ORDER BY o, event_id LIMIT 100""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return runs.stratified_sample(R.scored(spark, sf).select("event_id", "pipeline"), "pipeline", 100, ["event_id"], 5)


@query(f"""WITH {R.SQL_SCORED}, f AS (SELECT pipeline, stratum, query_id, min(event_id) AS event_id FROM scored GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY pipeline, stratum ORDER BY event_id, query_id) AS k FROM f)
SELECT pipeline, stratum, query_id, event_id FROM k WHERE k <= 25""")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return runs.quota(R.scored(spark, sf), ["pipeline", "stratum"], "query_id", "event_id", 25)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events")
def trace_positions(spark: SparkSession, sf: str) -> DataFrame:
    return runs.row_positions(table(spark, sf, "events").select("event_id"), "event_id")


# --- agent and judge --------------------------------------------------------------------------------------------------


@query(f"""WITH {R.SQL_HITS}, c AS (SELECT query_id, count(*) AS n, 5 + 10 * (query_id // 100 % 4) AS need FROM ranked WHERE rank <= 30 GROUP BY 1)
SELECT query_id, 'semantic' AS intent, CASE WHEN need <= 30 THEN 'sufficient' ELSE 'continue' END AS verdict, CAST(CASE need WHEN 5 THEN 0 WHEN 15 THEN 1 WHEN 25 THEN 2 ELSE 3 END AS INTEGER) AS iter_count,
       CAST(CASE need WHEN 5 THEN 10 WHEN 15 THEN 20 ELSE 30 END AS INTEGER) AS n_chunks FROM c""")
def agent_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Three bounded rounds of retrieval; a question's need says when its context is enough."""
    q = R.questions(spark, sf).select("query_id", F.lit("what follows").alias("query"))
    ranked = vectors.top_k(R.questions(spark, sf), R.vectors_of(spark, sf), 30)
    need = 5 + 10 * (F.floor(F.col("query_id") / 100) % 4)
    return agent.rounds(agent.start(q), ranked, F.size("chunks") >= need).select("query_id", "intent", "verdict", "iter_count", F.size("chunks").alias("n_chunks"))


@query("WITH l AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN l USING (conv_id) WHERE c.turn > l.m")
def after_last_call(spark: SparkSession, sf: str) -> DataFrame:
    return agent.after_last_call(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query(f"""WITH {R.SQL_HITS}, c AS (SELECT query_id, 'DOC-' || id AS id, rank FROM ranked WHERE rank <= 5)
SELECT query_id, 'According to ' || string_agg('[' || id || ']', ', ' ORDER BY rank) FILTER (WHERE rank <= 3) || '.' || CASE WHEN query_id % 200 = 0 THEN ' See XYZ-999.' ELSE '' END AS answer, query_id % 200 <> 0 AS faithful FROM c GROUP BY query_id""")
def answer_and_judge(spark: SparkSession, sf: str) -> DataFrame:
    """The offline generator quotes its context; every second answer also cites what isn't there, and the offline judge sees it."""
    c = top_k(spark, sf).filter("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("DOC-"), F.col("id").cast("string")).alias("id")))).alias("r"))
    ids = F.col("r.id")
    answer = F.concat(QuoteFirst(3).answer(F.lit(""), ids), F.when(F.col("query_id") % 200 == 0, " See XYZ-999.").otherwise(""))
    return c.select("query_id", answer.alias("answer"), CitedInContext().faithful(answer, ids).alias("faithful"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_run_keys(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream, appended once a key, then the same stream again as a new run: nothing is added twice."""
    from ..streaming.append import append_stream

    base = folder(spark, "stream")
    kind = table(spark, sf, "events").schema
    for i in range(2):
        s = spark.readStream.schema(kind).parquet(f"{sf}/events.parque[t]").select("user_id", "event_type")  # a pattern may be a file or a folder
        append_stream(s, f"{base}/log", f"{base}/checkpoint{i}", ["user_id", "event_type"]).awaitTermination()
    return spark.read.parquet(f"{base}/log")



# --- benchmark corpora, judgments, reports ----------------------------------------------------------------------------


def _multi_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as multi-hop questions: turns are paragraphs, the assistant's are supporting, the number of turns gives the class."""
    t = table(spark, sf, "conversations")
    each = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text", (F.col("role") == "assistant").alias("is_supporting")))).alias("paragraphs"))
    kind = F.concat(F.least(F.lit(4), F.greatest(F.lit(2), F.size("paragraphs"))).cast("string"), F.lit("hop__"), F.col("conv_id").cast("string"))
    x = each.select("conv_id", kind.alias("question_id"), F.format_string("question %d", "conv_id").alias("query"), "paragraphs")
    return x.withColumn("stratum", benchmarks.mapped(benchmarks.hop_class(F.col("question_id")), benchmarks.HOP_CLASS))


_SIZES = {"1-hop": 67, "2-hop": 67, "3+-hop": 66}
SQL_MULTI = """n AS (SELECT conv_id, least(4, greatest(2, count(*))) AS c FROM conversations GROUP BY 1),
st AS (SELECT conv_id, c || 'hop__' || conv_id AS question_id, CASE c WHEN 2 THEN '1-hop' WHEN 3 THEN '2-hop' ELSE '3+-hop' END AS stratum FROM n),
o AS (SELECT *, md5('11|' || conv_id) AS h FROM st), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, conv_id) AS k FROM o),
sampled AS (SELECT *, row_number() OVER (ORDER BY h, CAST(conv_id AS VARCHAR)) - 1 AS q_idx FROM k WHERE k <= CASE stratum WHEN '1-hop' THEN 67 WHEN '2-hop' THEN 67 ELSE 66 END),
para AS (SELECT q_idx, question_id, conv_id, stratum, row_number() OVER (PARTITION BY q_idx ORDER BY turn) - 1 AS p_idx, role, text, role = 'assistant' AS sup FROM sampled JOIN conversations USING (conv_id)),
named AS (SELECT *, printf('CV-%03d-P%02d', q_idx, p_idx) AS id FROM para)"""


@query(f"WITH {SQL_MULTI} SELECT id, role || ': ' || text AS text, role AS title, sup AS is_supporting, question_id, q_idx, CAST(p_idx AS INTEGER) AS p_idx FROM named")
def benchmark_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    q = benchmarks.sampled_questions(_multi_hop(spark, sf), "stratum", _SIZES, "conv_id", 11)
    return benchmarks.paragraphs(q, "CV", "question_id")


@query(f"WITH {SQL_MULTI}, s AS (SELECT id AS source, lead(id) OVER (PARTITION BY q_idx ORDER BY p_idx) AS target FROM named WHERE sup) SELECT source, target, 'REFERENCES' AS rel_type FROM s WHERE target IS NOT NULL")
def benchmark_edges(spark: SparkSession, sf: str) -> DataFrame:
    return benchmarks.support_edges(benchmark_paragraphs(spark, sf))


@query(f"""WITH {SQL_MULTI}, g AS (SELECT q_idx, string_agg(id, ';' ORDER BY p_idx) AS ids, min(id) AS a, max(id) AS b FROM named WHERE sup GROUP BY 1)
SELECT q_idx, 'question ' || conv_id AS query, stratum AS type, CAST(CASE stratum WHEN '1-hop' THEN 1 WHEN '2-hop' THEN 2 ELSE 3 END AS INTEGER) AS hop_count, coalesce(ids, '') AS expected_ids, coalesce(a, '') AS source_id, coalesce(b, '') AS target_id
FROM sampled LEFT JOIN g USING (q_idx)""")
def benchmark_manifest(spark: SparkSession, sf: str) -> DataFrame:
    q = benchmarks.sampled_questions(_multi_hop(spark, sf), "stratum", _SIZES, "conv_id", 11)
    m = benchmarks.manifest(q, benchmarks.paragraphs(q, "CV", "question_id"), "stratum", "CV")
    return m.select("q_idx", "query", "type", "hop_count", F.array_join("expected_ids", ";").alias("expected_ids"), "source_id", "target_id")


def _two_judgments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = R.ratings(spark, sf)
    return r.select("doc_id", "source", F.col("a").alias("faithful")), r.select("doc_id", (~F.col("b")).alias("faithful"))


@query(f"""WITH {R.SQL_RATINGS} SELECT source, count(*) AS n, count(*) FILTER (WHERE a AND b) AS to_false, count(*) FILTER (WHERE NOT a AND NOT b) AS to_true,
round((count(*) FILTER (WHERE a AND b) + count(*) FILTER (WHERE NOT a AND NOT b)) / count(*), 6) AS flip_rate FROM ratings GROUP BY source""")
def judge_flips(spark: SparkSession, sf: str) -> DataFrame:
    """A second judgment (not toxic) against the first (quality): how often verdicts flip, and which way."""
    return judging.flips(*_two_judgments(spark, sf), ["doc_id"], ["source"]).withColumn("flip_rate", r6("flip_rate"))


@query(f"""WITH {R.SQL_RUNS} SELECT pipeline AS judge, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens_in, CAST(sum(n_cited) AS BIGINT) AS tokens_out,
round(CASE pipeline WHEN 'click' THEN (sum(total_tokens) * 2.5 + sum(n_cited) * 10) / 1e6 WHEN 'view' THEN (sum(total_tokens) * 0.5 + sum(n_cited) * 3) / 1e6 END, 6) AS dollars FROM runs GROUP BY pipeline""")
def judge_cost(spark: SparkSession, sf: str) -> DataFrame:
    calls = R.run_log(spark, sf).select(F.col("pipeline").alias("judge"), F.col("total_tokens").alias("tokens_in"), F.size("cited_ids").alias("tokens_out"))
    return judging.cost(calls, {"click": (2.5, 10.0), "view": (0.5, 3.0)}).withColumn("dollars", r6("dollars"))


@query(f"""WITH {R.SQL_HITS}, {R.SQL_CHUNKS}, h AS (SELECT query_id, rank, id, module, heading FROM ranked JOIN chunks USING (id) WHERE rank <= 10)
SELECT q.query_id, coalesce('Found ' || count(h.id) FILTER (WHERE h.id IS NOT NULL) || ' requirements:' || chr(10) || string_agg('- [' || h.id || '] (' || module || ' :: ' || substring(heading, 1, 60) || ')', chr(10) ORDER BY h.rank), 'No matching requirements found.') AS summary
FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN h USING (query_id) GROUP BY q.query_id""")
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    hits = top_k(spark, sf).join(R.chunks(spark, sf).select("id", "module", "heading"), "id")
    return reports.search_summary(hits, R.questions(spark, sf))


@query(f"""WITH {R.SQL_MEANS}, c AS (SELECT pipeline, stratum, avg(score) AS m FROM means GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY m DESC, pipeline) = 1 AS best FROM c),
t AS (SELECT pipeline, stratum, CASE WHEN best THEN '**' ELSE '' END || printf('%.3f', m) || CASE WHEN best THEN '**' ELSE '' END AS t FROM k)
SELECT pipeline, coalesce(max(t) FILTER (WHERE stratum = '1-hop'), '---') AS h1, coalesce(max(t) FILTER (WHERE stratum = '2-hop'), '---') AS h2, coalesce(max(t) FILTER (WHERE stratum = '3+-hop'), '---') AS h3 FROM t GROUP BY pipeline""")
def report_table(spark: SparkSession, sf: str) -> DataFrame:
    c = _cells(spark, sf).withColumn("lo", F.lit(None).cast("double"))
    t = reports.table(reports.marked_cells(c, "stratum", "pipeline", "mean_score", "lo", "lo"), "pipeline", "stratum", list(STRATA))
    return t.toDF("pipeline", "h1", "h2", "h3")


@query()
def significance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Paired tests of all pipelines in each stratum: Wilcoxon's p, Holm over the family, Cliff's delta, interval of the mean
    difference, and the joint verdict."""
    by = ["stratum", "pipeline_i", "pipeline_j"]
    pairs = _pairs(spark, sf)
    w = significance.signed_rank_p(significance.wilcoxon(pairs, ["stratum"]))
    d = significance.cliffs_delta(pairs, ["stratum"]).select(*by, F.col("delta").alias("cliffs_delta"), F.col("magnitude").alias("cliffs_magnitude"))
    ci = significance.bca_mean(pairs.withColumn("d", F.col("x") - F.col("y")), by, "d", ["query_id"]).select(*by, F.col("mean").alias("mean_delta"), "ci_lo", "ci_hi", ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).alias("ci_excludes_zero"))
    x = significance.holm(w.select(*by, "n_paired", "wilcoxon_p"), "wilcoxon_p").join(d, by).join(ci, by, "left")
    return significance.joint_significance(x)
