"""Mix sources to target weights by Pfair scheduling, with DataFrame functions only.

Method. Time runs in slots of one block of documents. Target weights become whole shares a of a period of P slots. Block k of a
source with share a is released at floor(k P / a) and due at ceil((k + 1) P / a); earliest deadline first over the released
blocks fills every slot and meets every deadline, so at any time each source is less than one block from its weight. The
calendar of one period depends on the weights alone and repeats.

Scale. The calendar is one row's array expression of P = max(slots, 4 x sources) steps over a sorted array of the released blocks,
each step in proportion to the sources: a second for 1,000 sources, seven for 10,000. A document's rank in its source
comes from counts by hash bucket (4,096 rows a source at most, written and joined back by measured size) and a window inside a
bucket, so a source with a third of all rows is spread over its buckets. When a source is used up its slots stay empty and the
others keep their proportions: no document is dropped; `in_target` marks the slots before the first source runs out, where the
weights hold exactly.

Documents of a source are in order of the md5 of their doc_id and text, so rows without a doc_id, or that share one, are spread
too; only rows equal in both are in one bucket. A null source is a source; null doc_ids and texts are allowed; repeated rows are
scheduled once each; extra columns are kept (the added names replace columns of the same name); an empty table gives an empty
result. A weight is a positive number; sources that aren't named weigh 1. Without weights, n documents weigh n ** alpha.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, written

BLOCK_DOCS, SLOTS, ALPHA = 8, 1000, 0.5
ADDED = ("block", "slot", "position", "in_target")


def shares(sizes: DataFrame, slots: int, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """source, n, share, period: whole shares of a period by largest remainder, each at least 1. sizes: source, n."""
    if weights is None:
        w = F.round(F.pow(F.col("n").cast("double"), F.lit(alpha)) * 1000).cast("long")
    else:
        w = F.coalesce(*(F.when(F.col("source") == k, F.lit(round(v * 1_000_000))) for k, v in weights.items()), F.lit(1_000_000)).cast("long")
    x = sizes.withColumn("w", F.greatest(w, F.lit(1)))
    every = Window.partitionBy(F.lit(0))  # one row a source
    x = x.withColumn("p", F.greatest(F.lit(slots), 4 * F.count("*").over(every))).withColumn("all", F.sum("w").over(every))
    # one slot each, the others by weight
    x = x.withColumn("free", F.col("p") - F.count("*").over(every))
    x = x.withColumn("low", F.expr("(w * free) div all")).withColumn("rest", F.expr("(w * free) % all"))
    left = F.col("free") - F.sum("low").over(every)
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), F.asc_nulls_first("source")))
    return x.select("source", "n", (1 + F.col("low") + F.when(k <= left, 1).otherwise(0)).cast("int").alias("share"), F.col("p").cast("int").alias("period"))


def calendar(shared: DataFrame) -> DataFrame:
    """source, k, t: the slot t of a period that earliest deadline first gives to the k-th block of each source."""
    j = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("source"))) - 1  # one row a source
    named = written(shared.select("source", "share", F.col("period").alias("p"), j.alias("j")).coalesce(1), "sources")
    blocks = named.select("j", "p", "share", F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("k"))
    blocks = blocks.select(F.expr("cast(k AS bigint) * p div share").cast("int").alias("t"), F.expr("((cast(k AS bigint) + 1) * p + share - 1) div share * 2147483648 + j").alias("due"))
    released = blocks.groupBy("t").agg(F.sort_array(F.collect_list("due")).alias("due"))
    slots = named.agg(F.max("p").alias("p")).filter("p is not null").select(F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("t"))
    one = slots.join(released, "t", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("t", "due"))).alias("r")).filter("size(r) > 0")
    none = "cast(array() AS array<bigint>)"
    # ready: released blocks by due date; a step takes the first. Picks are gathered 256 at a time.
    step = f"""transform(array(if(x.due IS NULL, acc.ready, sort_array(concat(acc.ready, x.due)))), ready ->
                 named_struct('ready', slice(ready, 2, greatest(size(ready) - 1, 0)), 'out', concat(acc.out, slice(ready, 1, 1))))[0]"""
    edf = f"""aggregate(sequence(0, (size(r) - 1) div 256), named_struct('ready', {none}, 'out', {none}),
                (all, c) -> transform(array(aggregate(slice(r, c * 256 + 1, 256), named_struct('ready', all.ready, 'out', {none}), (acc, x) -> {step})), z ->
                  named_struct('ready', z.ready, 'out', concat(all.out, z.out)))[0],
                all -> all.out)"""
    picks = one.select(F.posexplode(F.expr(edf)).alias("t", "due")).select("t", F.expr("cast(due % 2147483648 AS int)").alias("j"))
    k = F.row_number().over(Window.partitionBy("j").orderBy("t")) - 1
    return picks.join(named.select("source", "j"), "j").select("source", k.cast("int").alias("k"), "t")


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS, alpha: float = ALPHA) -> DataFrame:
    """docs with its columns renamed by place (u0, u1, ...), so that no name clashes, and block (in its source), slot, position
    (slot and place in its block: unique, the order of the mix), in_target."""
    text, doc, source = (f"u{docs.columns.index(c)}" for c in ("text", "doc_id", "source"))
    d = by_place(docs)
    mine = d.columns
    d = d.withColumn("_tie", F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    d = d.withColumn("_h", F.md5(F.concat_ws("|", F.coalesce(F.col(doc).cast("string"), F.lit("")), "_tie"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = written(d.groupBy(F.col(source).alias("source"), "_b").agg(F.count("*").alias("m")), "counts")
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
    starts = written(counts.select(F.col("source").alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("_base")), "starts")
    shared = written(shares(counts.groupBy("source").agg(F.sum("m").alias("n")), slots, weights, alpha).coalesce(1), "shares")
    cal = calendar(shared).withColumnRenamed("source", "_src")
    plan = shared.join(cal, F.col("source").eqNullSafe(F.col("_src"))).select(F.col("source").alias("_src"), "n", "share", "period", "k", "t")
    plan = written(plan.coalesce(1), "calendar")  # its size is known, so the joins below choose their way by it
    blocks = F.ceil(F.col("n") / block_docs)
    ends = plan.filter(blocks % F.col("share") == F.col("k")).agg(F.min(F.floor(blocks / F.col("share")) * F.col("period") + F.col("t"))).first()[0]
    inside = Window.partitionBy(source, "_b").orderBy("_h", doc, "_tie")
    x = d.withColumn("_r", F.row_number().over(inside)).join(starts, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    x = x.withColumn("_r", F.col("_base") + F.col("_r") - 1).withColumn("block", F.floor(F.col("_r") / block_docs))
    share = plan.filter("k = 0").select(F.col("_src").alias("_name"), F.col("share").alias("_share"), F.col("period").alias("_period"))
    # the share by source; then the slot by source and place in the period
    y = x.join(share, F.col(source).eqNullSafe(F.col("_name")))
    y = y.join(plan.select("_src", "k", "t"), F.col(source).eqNullSafe(F.col("_src")) & ((F.col("block") % F.col("_share")) == F.col("k")))
    y = y.withColumn("slot", F.floor(F.col("block") / F.col("_share")) * F.col("_period") + F.col("t"))
    y = y.withColumn("position", F.col("slot") * block_docs + F.col("_r") % block_docs)
    return y.withColumn("in_target", F.col("slot") < F.lit(ends if ends is not None else 0)).select(*mine, *ADDED)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS, alpha: float = ALPHA, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if none are named), then block, slot, position and in_target as in scheduled, which take the
    place of columns of the same names."""
    kept = [i for i, c in enumerate(docs.columns) if c in (keep or docs.columns) and c not in ADDED]
    out = scheduled(docs, weights, block_docs, slots, alpha).select(*(f"u{i}" for i in kept), *ADDED)
    return out.toDF(*(docs.columns[i] for i in kept), *ADDED)


ORACLE = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, greatest(CAST(round(pow(CAST(n AS DOUBLE), {ALPHA}) * 1000) AS BIGINT), 1) AS w,
             greatest({SLOTS}, 4 * count(*) OVER ()) AS p, count(*) OVER () AS c FROM sizes),
v AS (SELECT *, CAST(sum(w) OVER () AS BIGINT) AS total, p - c AS free FROM w),
u AS (SELECT *, (w * free) // total AS low, (w * free) % total AS rest FROM v),
r AS (SELECT *, free - CAST(sum(low) OVER () AS BIGINT) AS left_over, row_number() OVER (ORDER BY rest DESC, source NULLS FIRST) AS k FROM u),
shares AS (SELECT source, n, p, 1 + low + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS a,
                  row_number() OVER (ORDER BY source NULLS FIRST) AS j FROM r),
state(t, j, a, p, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), j, a, p, CAST(0 AS BIGINT), false FROM shares
  UNION ALL
  SELECT t, j, a, p, done + CASE WHEN best = j THEN 1 ELSE 0 END, best = j
  FROM (
    SELECT t + 1 AS t, j, a, p, done,
           first_value(j) OVER (ORDER BY CASE WHEN done < a AND (done * p) // a <= t + 1 THEN ((done + 1) * p + a - 1) // a ELSE 9000000000000000 END, j) AS best
    FROM state WHERE t + 1 < p)),
cal AS (SELECT j, t, row_number() OVER (PARTITION BY j ORDER BY t) - 1 AS k FROM state WHERE pick),
plan AS (SELECT s.source, s.n, s.a, s.p, cal.k, cal.t FROM shares s JOIN cal USING (j)),
ends AS (SELECT min(((n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS}) // a * p + t) AS e FROM plan WHERE ((n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS}) % a = k),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), doc_id) - 1 AS r FROM documents),
f AS (SELECT d.doc_id, d.source, d.r, d.r // {BLOCK_DOCS} AS block, s.a, s.p FROM d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT f.doc_id, f.source, f.block, (f.block // f.a) * f.p + plan.t AS slot,
       ((f.block // f.a) * f.p + plan.t) * {BLOCK_DOCS} + f.r % {BLOCK_DOCS} AS position,
       (f.block // f.a) * f.p + plan.t < (SELECT e FROM ends) AS in_target
FROM f JOIN plan ON f.source IS NOT DISTINCT FROM plan.source AND f.block % f.a = plan.k
"""
