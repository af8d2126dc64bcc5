"""A Parquet table of one row a key, dealt to buckets by the key's hash: an upsert rewrites the buckets it touches and no other file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import forget, parts_for, written


class KeyedTable:
    """The table at path. Upserts of one table must follow each other: two at once may each rewrite a bucket without the other's rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/_meta").first()
        self.key, self.buckets, self.vector, self.length = list(meta["key"]), meta["buckets"], meta["vector"], meta["length"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int | None = None, vector: str | None = None) -> KeyedTable:
        """Write rows (one is kept of those that share a key). With vector, a column of arrays, all must have one length, now and in
        later upserts. buckets: as many as there are 64 MB of input, 16 at least, if not given."""
        buckets = buckets or parts_for(rows, 64 << 20, least=16)
        length = _length(rows, vector)
        meta = rows.sparkSession.createDataFrame([(key, buckets, vector, length)], "key array<string>, buckets int, vector string, length int")
        _put(rows.dropDuplicates(key).withColumn("_bucket", _bucket(key, buckets)), path, buckets)
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_meta")
        return cls(rows.sparkSession, path)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("_bucket")

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only their buckets are read."""
        asked = keys.select(*self.key).distinct().withColumn("_bucket", _bucket(self.key, self.buckets))
        touched = [r[0] for r in asked.select("_bucket").distinct().collect()]  # buckets at most
        return self._stored().filter(F.col("_bucket").isin(touched)).join(asked, [*self.key, "_bucket"], "left_semi").drop("_bucket")

    def upsert(self, changes: DataFrame) -> int:
        """Put the rows of changes in place of those with the same key, and add the others; a key twice in changes counts once.
        Columns that changes lacks are null. Returns the number of buckets that were rewritten."""
        if self.vector and self.length is not None and (found := _length(changes, self.vector)) not in (None, self.length):
            raise ValueError(f"vectors of length {found} for a table of length {self.length}")
        new = written(changes.dropDuplicates(self.key).withColumn("_bucket", _bucket(self.key, self.buckets)), "changes")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        if touched:
            old = self._stored().filter(F.col("_bucket").isin(touched))
            kept = old.join(new.select(*self.key, "_bucket"), [*self.key, "_bucket"], "left_anti")
            merged = written(kept.unionByName(new, allowMissingColumns=True).select(*old.columns), "merged")  # not read and overwritten at once
            _put(merged, self.path, len(touched))
            forget(merged)
        forget(new)
        return len(touched)


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _length(rows: DataFrame, vector: str | None) -> int | None:
    """The one length of a column of arrays (None without rows, or column)."""
    if not vector:
        return None
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of different lengths, {low} to {high}")
    return high


def _put(rows: DataFrame, path: str, buckets: int) -> None:
    """Write rows over the buckets they lie in."""
    dealt = rows.repartition(min(buckets, 4096), "_bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
