"""Canonical exact digests of documents.

Method. A text is normalised (Unicode NFKC, case folding, runs of white space as one space, trimmed) and hashed with XXH3 to
128 bits. Rows with equal digests form a bucket; inside a bucket the canonical bytes themselves are compared, and should two
differ, those after the first by SHA-256 get a suffix: equal fingerprints mean equal canonical texts. The likeness of two
fingerprints is 1 if their canonical bytes are equal, else 0.

Scale. One range shuffle by doc_id brings each document beside its successor; a range also gets the first document of the
next one, found from the ids alone. Buckets are checked on the canonical texts of repeated digests only: a bit map of fixed
size (2 MB at most) lets through their rows, and an aggregate by (digest, bytes) folds copies on the map side, so a group of a
third of all rows costs one row a task.

A null text is empty; repeated rows have equal fingerprints and are each other's successors; rows of one doc_id are ordered by
text; null doc_ids come last, in order of a hash of their text (so they are spread over ranges of their own), then the text; extra
columns are ignored; an empty table gives an empty result, and a single document is its own successor.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, parts_for, quantile_bounds, tidy, written

MAP_BITS = 24
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _with_successors(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in ranges of doc_id, each range ended by the row that follows it (after the last: the first); extra marks that."""
    loose = F.col("doc_id").isNull()
    some = not docs.filter(loose).isEmpty()  # texts are read for their hash only if some rows need it
    docs = docs.withColumn("at", F.coalesce("doc_id", F.xxhash64("text")) if some else F.col("doc_id"))
    numbered = quantile_bounds(docs.filter(~loose).select("at"), "at", parts)
    others = quantile_bounds(docs.filter(loose).select("at"), "at", parts) if some else []
    docs = docs.withColumn("range", F.when(loose, bucket_of(F.col("at"), others) + len(numbered) + 1).otherwise(bucket_of(F.col("at"), numbered)))
    heads = {r["range"]: r["first"] for r in docs.groupBy("range").agg(F.min("at").alias("first")).collect()}  # one a range
    held = sorted(heads)
    before = {r: held[i - 1] for i, r in enumerate(held)}
    n = len(numbered) + len(others) + 2
    head, prev = F.lit([heads.get(r, 0) for r in range(n)]), F.lit([before.get(r, 0) for r in range(n)])
    here = F.struct(F.col("range").alias("to"), F.lit(0).alias("extra"))
    there = F.struct(F.get(prev, F.col("range")).alias("to"), F.lit(1).alias("extra"))
    rows = docs.withColumn("go", F.explode(F.when(F.get(head, F.col("range")) == F.col("at"), F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("doc_id", "text", "at", "go.to", "go.extra").repartitionById(n, F.col("to"))
    return rows.sortWithinPartitions("extra", "at", "text").select("doc_id", "text", "extra")


def neighbour_fingerprints(docs: DataFrame, hashed=digest) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the next document's first code points),
    before buckets are compared by bytes."""
    parts = parts_for(docs, 16 << 20, least=1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        last = None  # doc_id, text, canonical bytes, digest
        out: list[list] = [[] for _ in range(7)]

        def put(this, following):
            doc, text, canon, name = this
            new = edited(text, following[1])
            other = canonical(new)
            row = (doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), name, hashed(other), float(other == canon), float(following[2] == canon))
            for c, v in zip(out, row):
                c.append(v)

        def rows():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in RESULT.split(", ")])
            for c in out:
                c.clear()
            return done

        closed = False
        for batch in batches:
            for doc, text, extra in zip(*(c.to_pylist() for c in batch.columns)):
                if closed:
                    continue
                canon = canonical(text)
                this = (doc, text, canon, hashed(canon))
                if last is not None:
                    put(last, this)
                last, closed = this, bool(extra)
            yield rows()

    return _with_successors(docs, parts).mapInArrow(tidy(run), RESULT)


def _repeated(docs: DataFrame, found: DataFrame, hashed) -> DataFrame:
    """digest, canonical, rows: the distinct canonical texts of digests that occur more than once."""
    twice = found.groupBy("fingerprint").count().filter("count > 1")
    slot = F.conv(F.substring(F.sha2("fingerprint", 256), 1, MAP_BITS // 4), 16, 10).cast("long") + 1  # Spark's bit maps begin at 1
    slots = twice.select(slot.alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    size = 1 << MAP_BITS
    have = np.zeros(size // 8, np.uint8)
    for r in bits.collect():  # 2**MAP_BITS bits at most, whatever the input
        lo = (r["b"] - 1) * 4096
        have[lo : lo + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(have.tobytes())

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                canon = canonical(text or "")
                name = hashed(canon)
                s = int(hashlib.sha256(name.encode()).hexdigest()[: MAP_BITS // 4], 16)
                if shared.value[s // 8] >> (s % 8) & 1:
                    for c, v in zip(out, (doc, name, canon)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], ["doc_id", "name", "canon"])

    return docs.mapInArrow(tidy(run), "doc_id long, name string, canon binary")


def fingerprints(docs: DataFrame, hashed=digest) -> DataFrame:
    """The result described above; hashed may be another digest (tests use a weak one)."""
    found = written(neighbour_fingerprints(docs, hashed), "fingerprints")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = _repeated(plain, found, hashed)
    kinds = texts.groupBy("name", "canon").agg(F.count("*").alias("rows"))
    clash = kinds.groupBy("name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.sha2("canon", 256))).alias("order")).filter("n > 1").select("name", "order")
    clash = written(clash, "clashes")
    if clash.isEmpty():
        return found
    # different texts share a digest (none does in practice): name each text by its own bytes, and run again
    order = {r["name"]: r["order"] for r in clash.collect()}

    def named(canon: bytes) -> str:
        name = hashed(canon)
        if name not in order:
            return name
        sha = hashlib.sha256(canon).hexdigest()
        k = order[name].index(sha) if sha in order[name] else sha  # an edited text that no document has
        return f"{name}-{k}" if k else name

    return neighbour_fingerprints(docs, named)
