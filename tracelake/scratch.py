"""Shared scratch tables, input sizes, and range buckets."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_HOMES: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file bytes for a scan). No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int = 16 << 20, least: int = 8) -> int:
    """A partition count that follows the input's size, so that a partition's size doesn't; Spark's own, if that is unknown."""
    if plan_bytes(df) > 1 << 55:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(1 << 17, -(-plan_bytes(df) // bytes_each)))


def ranges_for(rows: int, each: int = 100_000) -> int:
    """How many ranges a table of so many rows is cut into: some 100,000 rows each, 16,384 ranges at most (larger ones then)."""
    return max(1, min(1 << 14, -(-rows // each)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without it a temporary one, but only where driver and executors are one machine:
    on a cluster each executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: scratch tables go there")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tracelake"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def _home(spark: SparkSession) -> str:
    """Where this application's scratch tables lie."""
    return f"{shared_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession, tag: str) -> str:
    """A new path among this application's scratch tables, for what a query writes and reads itself."""
    if _home(spark) not in _HOMES:
        _HOMES.add(_home(spark))
        atexit.register(clean, spark)
    return f"{_home(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more: not the results of a query, nor what they are read from."""
    for path, spark in {t._scratch: t.sparkSession for t in tables}.items():
        _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that were not yet collected or stored can't be read after it. It also
    runs at the program's end, if the session is still open then."""
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, _home(spark))
    except Exception:  # noqa: BLE001 - at the program's end the JVM may be gone
        pass


def bucket_of(col: Column, bounds: list) -> Column:
    """How many of the ascending bounds are <= col: a binary search inside one expression, so it stays in the JVM."""
    if not bounds:
        return F.lit(0)
    kind = "bigint" if all(type(x) is int for x in bounds) else "double" if all(type(x) in (int, float) for x in bounds) else None
    # one literal that the optimizer folds to an array, however many bounds there are
    b = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>") if kind else F.lit(list(bounds))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        go = (s["lo"] < s["hi"]) & (F.get(b, mid) <= col)
        return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda s: s["lo"])


def quantile_bounds(df: DataFrame, col: str, parts: int, weight: Column | None = None) -> list:
    """Ascending distinct cut points that split col into parts of about equal row counts (of equal sums of weight, a whole number
    from 1 on, if one is given: a row then counts so many times); as many values as partitions reach the driver."""
    if parts < 2:
        return []
    if weight is not None:
        df = df.select(F.explode(F.array_repeat(F.col(col), weight.cast("int"))).alias(col))
    probes = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(col, F.lit(probes), F.lit(max(1000, 10 * parts))).alias("q")).first()["q"]
    return sorted(set(found or []))


def following(df: DataFrame, group: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """df with next: the value of the row that follows in its group. Groups are cut at quantiles of the order, so a group of any
    size is spread; the first value of each later piece closes the gap. order must be unique within a group."""
    df = written(df, "ordered")  # read several times below, and counted
    bounds = quantile_bounds(df, order, parts or ranges_for(df.count()))
    x = df.withColumn("_b", bucket_of(F.col(order), bounds))
    inside = Window.partitionBy(group, "_b").orderBy(order)
    heads = x.groupBy(group, "_b").agg(F.min_by(value, order).alias("_first"))
    pieces = Window.partitionBy(group).orderBy("_b")  # one row a piece
    heads = heads.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.lead("_first").over(pieces).alias("_next"))
    x = x.withColumn("_in", F.lead(value).over(inside)).join(heads, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    return x.withColumn("next", F.coalesce("_in", "_next")).drop("_b", "_c", "_g", "_in", "_next")


def average_ranks(df: DataFrame, group: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with rank: the average rank (from 1) of value in its group. Equal values share a bucket, buckets are counted first, so
    no task sees a whole group; the rows of one value are counted, not sorted."""
    counts = written(df.groupBy(*group, value).agg(F.count("*").alias("_n")), "counts")
    bounds = quantile_bounds(counts, value, parts or ranges_for(counts.count()))
    counts = counts.withColumn("_b", bucket_of(F.col(value), bounds))
    buckets = counts.groupBy(*group, "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.withColumn("_base", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_low", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(base, [*group, "_b"])
    ranks = ranks.select(*group, value, (F.col("_base") + F.col("_low") + (F.col("_n") + 1) / 2).alias("rank"), F.col("_n").alias("ties"))
    return df.join(ranks, [*group, value])
