"""The star-schema tables in the roles of a corpus, a graph, questions, raters and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, vectors
from ..scratch import table, written
from ..schemas import LINK_TYPES, WALK_TYPES

EVENTS = ("click", "error", "purchase", "signup", "view")
LANGS = ("de", "en", "es", "fr")
SEED_COUNT = 8


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """documents as corpus rows: the first line is the heading, and each links to the next id and to another by a typed link."""
    d = table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", " references ").when(F.col("lang") == "fr", "derives_from").when(F.col("lang") == "de", "Satisfies").otherwise("allocates_to")
    other = F.when(F.col("doc_id") % 5 == 0, "mentions").otherwise("references")
    link = lambda to, t: F.struct(to.cast("string").alias("target_id"), t.alias("link_type"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("module"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading"), (1 + F.col("doc_id") % 3).cast("int").alias("level"),
        F.col("lang").alias("object_type"), F.lit("").alias("full_text"), "text", F.array(link(F.col("doc_id") + 1, kind), link(F.col("doc_id") * 3 + 1, other)).alias("outgoing_links"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunks(rows(spark, sf))


def typed_links(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.links(chunks(spark, sf)).withColumn("dst", F.col("dst").cast("long"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: walks read them several times, and their ends take a scan of all texts to check."""
    return written(corpus.resolved(corpus.known_links(typed_links(spark, sf)), chunks(spark, sf)), "edges")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("tag"))


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("tag"))


def seeds(spark: SparkSession, sf: str, k: int = SEED_COUNT) -> DataFrame:
    """Written once, as every branch of a context begins with them."""
    return written(vectors.top_k(questions(spark, sf), vectors_of(spark, sf), k).select("query_id", "id", "rank"), "seeds")


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Two raters' verdicts (quality, toxic) on each labelled document, with its language and source."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    x = table(spark, sf, "labels").join(d, "doc_id")
    return x.select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """events as scored runs: the type is the pipeline, the user the question, and its remainder by 3 the stratum."""
    s = F.when(F.col("user_id") % 3 == 0, "1-hop").when(F.col("user_id") % 3 == 1, "2-hop").otherwise("3+-hop")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("query_id"), F.col("event_type").alias("pipeline"), s.alias("stratum"), F.col("value").alias("score"), "props")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return scored(spark, sf).select("event_id", F.concat(F.lit("q"), "query_id").alias("query"), "pipeline", (k * 10 - 50).alias("latency_ms"), F.floor(F.col("score") * 10).alias("total_tokens"), F.slice(F.array(F.lit("ADS-1"), F.lit("FCC-2"), F.lit("NAV-3")), 1, (F.col("query_id") % 4).cast("int")).alias("cited_ids"))


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_in = lambda names: ", ".join(f"'{n}'" for n in names)
SQL_CHUNKS = """chunks AS (
  SELECT doc_id AS id, source AS module, split_part(text, chr(10), 1) AS heading, CAST(1 + doc_id % 3 AS INTEGER) AS level, lang AS object_type, trim(text) AS full_text
  FROM documents WHERE length(trim(text)) >= 30)"""
SQL_LINKS = f"""{SQL_CHUNKS},
links AS (
  SELECT id AS src, id + 1 AS dst, CASE object_type WHEN 'en' THEN 'REFERENCES' WHEN 'fr' THEN 'DERIVES_FROM' WHEN 'de' THEN 'SATISFIES' ELSE 'ALLOCATES_TO' END AS rel FROM chunks
  UNION ALL SELECT id, id * 3 + 1, CASE WHEN id % 5 = 0 THEN 'MENTIONS' ELSE 'REFERENCES' END FROM chunks)"""
SQL_EDGES = f"""{SQL_LINKS},
edges AS (
  SELECT DISTINCT src, dst, rel FROM links
  WHERE rel IN ({_in(LINK_TYPES)}) AND src IN (SELECT id FROM chunks) AND dst IN (SELECT id FROM chunks)),
walkable AS (SELECT * FROM edges WHERE rel IN ({_in(WALK_TYPES)})),
near AS (SELECT src AS a, dst AS b FROM walkable WHERE src <> dst UNION SELECT dst, src FROM walkable WHERE src <> dst)"""
SQL_HITS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label AS tag FROM embeddings WHERE vec_id % 100 = 0),
hits AS (
  SELECT q.query_id, e.vec_id AS id, round(1 - list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 6) AS distance, q.tag AS qtag, e.label AS tag
  FROM q CROSS JOIN embeddings e),
ranked AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM hits)"""
SQL_SEEDS = f"""{SQL_HITS},
seeds AS (SELECT query_id, id, rank FROM ranked WHERE rank <= {SEED_COUNT})"""
SQL_WALK = """one AS (SELECT DISTINCT s.query_id, n.b AS id FROM seeds s JOIN near n ON s.id = n.a WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.id = n.b)),
two AS (SELECT DISTINCT o.query_id, n.b AS id FROM one o JOIN near n ON o.id = n.a WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = o.query_id AND t.id = n.b)),
walked AS (SELECT query_id, id, min(hops) AS hops FROM (SELECT query_id, id, 1 AS hops FROM one UNION ALL SELECT query_id, id, 2 FROM two) GROUP BY 1, 2),
walk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, id) AS rank FROM walked)"""
SQL_RATINGS = """ratings AS (
  SELECT l.doc_id, d.lang, d.source, d.n_chars, quality = 1 AS a, toxic = 1 AS b FROM labels l JOIN documents d USING (doc_id))"""
SQL_SCORED = """scored AS (
  SELECT event_id, user_id AS query_id, event_type AS pipeline, CASE user_id % 3 WHEN 0 THEN '1-hop' WHEN 1 THEN '2-hop' ELSE '3+-hop' END AS stratum, value AS score, props
  FROM events)"""
SQL_MEANS = f"""{SQL_SCORED},
means AS (SELECT query_id, stratum, pipeline, avg(score) AS score FROM scored GROUP BY 1, 2, 3),
pairs AS (
  SELECT i.query_id, i.stratum, i.pipeline AS pipeline_i, j.pipeline AS pipeline_j, i.score AS x, j.score AS y
  FROM means i JOIN means j ON i.query_id = j.query_id AND i.pipeline < j.pipeline)"""
SQL_RUNS = f"""{SQL_SCORED},
runs AS (
  SELECT event_id, 'q' || query_id AS query, pipeline, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 10 - 50 AS latency_ms, CAST(floor(score * 10) AS BIGINT) AS total_tokens,
         least(query_id % 4, 3) AS n_cited FROM scored)"""


def sql_ppr(rounds: int = 20, alpha: float = 0.15) -> str:
    """Personalized PageRank as a chain of common table expressions, ending in ppr(query_id, id, score, rank)."""
    out = [
        "degree AS (SELECT a, count(*) AS d FROM near GROUP BY a)",
        "moves AS MATERIALIZED (SELECT n.a, n.b, 1.0 / CAST(d AS DOUBLE) AS w FROM near n JOIN degree USING (a) UNION ALL SELECT id, id, 1.0 FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) t WHERE id NOT IN (SELECT a FROM degree))",
        "m0 AS MATERIALIZED (SELECT query_id, id, 1.0 / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS mass FROM (SELECT DISTINCT query_id, id FROM seeds WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)) s)",
    ]
    for i in range(rounds):
        out.append(f"m{i + 1} AS MATERIALIZED (SELECT query_id, id, sum(mass) AS mass FROM (SELECT m.query_id, v.b AS id, m.mass * v.w * {1 - alpha} AS mass FROM m{i} m JOIN moves v ON m.id = v.a UNION ALL SELECT query_id, id, mass * {alpha} FROM m0) GROUP BY 1, 2)")
    out.append(f"ppr AS (SELECT query_id, id, round(mass, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 9) DESC, id) AS rank FROM m{rounds} m WHERE NOT EXISTS (SELECT 1 FROM m0 WHERE m0.query_id = m.query_id AND m0.id = m.id))")
    return ",\n".join(out)
