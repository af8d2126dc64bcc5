"""Resample documents towards a target distribution by importance weights over hashed n-grams.

Method. Features are runs of 1 to 2 words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. First pass: every task
counts the buckets of its Arrow batches with np.bincount, and treeReduce merges those vectors, for the documents and for the
target. A bucket's gain is the log ratio of its smoothed shares, in floored thousandths. Second pass: tasks gather the broadcast
gains and sum them up a document (bincount with weights); the floored mean is the document's weight. Gumbel noise from a hash of
doc_id is added, and the highest scores are drawn: sampling without replacement in proportion to exp(weight / 1000).

Scale. Both passes are map only over whole texts, half a megabyte at a time; a vector has BUCKETS numbers. CRCs of words come from a
table walk over all words at once; those of word pairs follow from their words' by shifting one over the other's length, so no pair
is ever built. Scores are whole numbers whose range depends on the logarithm of the corpus only (some 10**5 values at 10**13
features), so the driver gets exact counts by score, the cut among them, and where ranks of a range of scores begin; only the drawn
rows are shuffled, into ranges of some RANGE rows (rows of one score stay together), and ranked there.

A null or empty text, or one without words, has no features and weight 0. A null doc_id is hashed as the word `null` and follows all
others in ties. Repeated rows are scored and ranked once each (ties among equal doc_ids go by n_features). Extra columns are ignored,
whatever their names. An empty table gives an empty result; an empty target gives gains from smoothing alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, chunks, text_bytes, tidy, written

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
RANGE, RANGES = 100_000, 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
#: Words up to this many bytes go through tables; longer ones, through zlib.
_TABLED = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 of single bytes, and a register's value after n more zero bytes, by n and the register's four bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    shift = np.empty((_TABLED + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_TABLED):
        shift[n + 1] = one[shift[n] & 255] ^ (shift[n] >> np.uint32(8))
    return one, shift


_ONE, _SHIFT = _tables()


def word_crcs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """CRC-32 of the words of all texts in order, their lengths, the number of words of each text, and where words lie."""
    joined = b" ".join([b"", *texts, b""]).translate(_LOWER)
    a = np.frombuffer(joined, np.uint8)
    word = _WORD[a]
    starts = np.flatnonzero(~word[:-1] & word[1:]) + 1
    sizes = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - starts
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    order = np.argsort(-np.minimum(sizes, _TABLED), kind="stable")  # the words that still have bytes are always the first
    at, size = starts[order], np.minimum(sizes[order], _TABLED)
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    more = len(order) - np.cumsum(np.bincount(size, minlength=_TABLED + 1))
    for p in range(_TABLED):
        m = int(more[p])
        if not m:
            break
        c[:m] = _ONE[(c[:m] ^ a[at[:m] + p]) & 255] ^ (c[:m] >> np.uint32(8))
    crcs = np.empty_like(c)
    crcs[order] = ~c
    for i in np.flatnonzero(sizes > _TABLED).tolist():
        crcs[i] = zlib.crc32(joined[starts[i] : starts[i] + sizes[i]])
    return crcs, sizes, counts, joined, starts


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature (all words, then all pairs), and the number of words of each text."""
    crcs, sizes, counts, joined, starts = word_crcs(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.flatnonzero(owner[:-1] == owner[1:])
    left = ~crcs[first]
    left = ~(_ONE[(left ^ np.uint32(32)) & 255] ^ (left >> np.uint32(8)))  # the word and a space
    n = sizes[first + 1]
    t = np.minimum(n, _TABLED)
    pairs = crcs[first + 1].copy()
    for k in range(4):
        pairs ^= _SHIFT[t, k, (left >> np.uint32(8 * k)) & 255]
    for j in np.flatnonzero(n > _TABLED).tolist():
        i = starts[first[j] + 1]
        pairs[j] = zlib.crc32(joined[i : i + n[j]], int(left[j]))
    return np.concatenate((crcs, pairs)) % np.uint32(buckets), np.concatenate((owner, owner[first])), counts


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) lie in each bucket: one vector a task, merged in a tree."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for lo, hi in chunks(texts):
                total += np.bincount(feature_buckets(texts[lo:hi], buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's floored thousandths of the log ratio of its share in the target to that in the source, each count one more."""
    b = len(source)
    ratio = (target + 1.0) * (source.sum() + float(b)) / ((source + 1.0) * (target.sum() + float(b)))
    return np.floor(1000 * np.log(ratio))


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight, n_words: the floored mean gain of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        gain = shared.value
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n, total, words = (np.zeros(len(texts), np.int64) for _ in range(3))
            for lo, hi in chunks(texts):
                where, owner, counts = feature_buckets(texts[lo:hi], len(gain))
                words[lo:hi] = counts
                n[lo:hi] = np.bincount(owner, minlength=hi - lo)
                total[lo:hi] = np.bincount(owner, gain[where], minlength=hi - lo)  # whole numbers: exact
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1)), pa.array(words)], ["doc_id", "n_features", "weight", "n_words"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, n_features long, weight long, n_words long")


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (a written table of doc_id, n_features, weight, n_words, score) with rank: 1, 2, ... for the percent highest scores among
    rows of least_words words or more, ties to the smaller doc_id; null for all others."""
    can = F.col("n_words") >= least_words
    counts = sorted(((r[0], r[1]) for r in rows.filter(can).groupBy("score").count().collect()), reverse=True)  # bounded, see above
    drawn = percent * sum(n for _, n in counts) // 100
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if not drawn:
        return none
    each = max(1, min(RANGE, drawn // 64), drawn // RANGES)
    bounds, base, before, cut, held = [], [0], 0, None, 0
    for score, n in counts:
        if before >= drawn:
            break
        if held >= each:  # a new range begins with this score
            bounds.append(-score)
            base.append(before)
            held = 0
        before, held, cut = before + n, held + n, score
    near = can & (F.col("score") >= cut)
    part = rows.filter(near).withColumn("_b", bucket_of(-F.col("score"), bounds))
    inside = Window.partitionBy("_b").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features")
    starts = F.split(F.lit(",".join(map(str, base))), ",").cast("array<bigint>")
    rank = F.get(starts, F.col("_b")) + F.row_number().over(inside)
    part = part.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return part.drop("_b").union(none.filter(~near))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); target has texts of the wanted kind (text)."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(weighted(docs, gain).withColumn("score", F.col("weight") + noise), "scores")
    return draw(rows, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH tab AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
words AS (
  SELECT part, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT 's' AS part, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
features AS (
  SELECT part, doc_id, len(w) AS n_words,
         list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS f FROM words),
single AS (SELECT part, doc_id, unnest(f) AS f FROM features),
hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(f) + 1), lambda i: CAST('0x' || substr(hex(f), 2 * i - 1, 2) AS BIGINT))),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM single), tab),
placed AS (SELECT part, doc_id, b FROM single JOIN hashed USING (f)),
counts AS (SELECT b, count(*) FILTER (part = 's') AS s, count(*) FILTER (part = 't') AS t FROM (SELECT part, b FROM placed UNION ALL SELECT 'x', range FROM range({BUCKETS})) GROUP BY b),
gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + {BUCKETS}) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain FROM counts),
summed AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM placed JOIN gain USING (b) WHERE part = 's' GROUP BY doc_id),
scored AS (
  SELECT doc_id, n_words, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM features LEFT JOIN summed USING (doc_id) WHERE part = 's'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
