"""Readers and writers. Id lists are joined by ';' only here, at the edge; inside they are arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..scratch import written


def split_ids(col: Column) -> Column:
    """The distinct trimmed parts of a ';'-joined list, in order, without blanks; null is empty."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def join_ids(col: Column) -> Column:
    return F.array_join(F.coalesce(col, F.array().cast("array<string>")), ";")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows from JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.CHUNK).json(path).filter("id is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their gold ids. A question that occurs again counts as its last line; a missing type is 'unknown'."""
    lines = spark.read.schema(schemas.MANIFEST).json(path).filter("query is not null")
    lines = lines.select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    last = Window.partitionBy("query").orderBy(F.desc("_f"), F.desc("_i"))
    one = lines.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_f", "_i")
    return one.withColumn("type", F.coalesce("type", F.lit("unknown")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.schema(schemas.EDGE).json(path)
    return e.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.upper(F.trim("rel_type")).alias("rel")).filter("src is not null and dst is not null")


def read_runs(spark: SparkSession, path: str, schema: str = schemas.RUN) -> DataFrame:
    """A trace from CSV, id lists as arrays. Columns are matched by header name; those the file lacks are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    cols = []
    for name, kind in fields:
        if name not in raw.columns:
            cols.append(F.lit(None).cast(kind).alias(name))
        elif name in ("cited_ids", "source_ids"):
            cols.append(split_ids(F.col(name)).alias(name))
        elif kind == "boolean":
            cols.append(verdict(F.col(name)).alias(name))
        else:
            cols.append(F.col(name).try_cast(kind).alias(name))
    return raw.select(*cols)


def verdict(col: Column) -> Column:
    """'True' and 'False' as booleans; anything else is no verdict (null), never a judgment."""
    return F.when(F.lower(F.trim(col.cast("string"))) == "true", True).when(F.lower(F.trim(col.cast("string"))) == "false", False)


def requirement_records(spark: SparkSession, path: str) -> DataFrame:
    """id, module, heading, full_text, outgoing_links from requirement documents in text form ('|| Requirement No:.. ||')."""
    whole = spark.read.text(path, wholetext=True)
    module = F.regexp_extract("value", r"(?m)^MODULE NAME:\s*(\S+)", 1)
    parts = whole.select(module.alias("module"), F.posexplode(F.split("value", r"(?m)^Header:\s*")).alias("part", "body"))
    parts = parts.filter("part > 0").withColumn("heading", F.trim(F.regexp_extract("body", r"\A([^\n]*)", 1)))
    record = r"\|\|\s*Requirement No:\s*(\S+)\s*\|\|\s*Requirement:\s*([\s\S]*?)\s*\|\|"
    found = parts.select("module", "heading", F.explode(F.expr(f"arrays_zip(regexp_extract_all(body, r'{record}', 1), regexp_extract_all(body, r'{record}', 2))")).alias("r"))
    links = r"(?m)^(Satisfies|References|Verifies|Derives From|Refines):[ \t]*(.*)$"
    body = F.col("r.1")
    typed = F.arrays_zip(F.regexp_extract_all(body, F.lit(links), F.lit(1)).alias("t"), F.regexp_extract_all(body, F.lit(links), F.lit(2)).alias("v"))
    ids = F.flatten(F.transform(typed, lambda x: F.transform(F.filter(F.transform(F.split(x["v"], "[,;]"), lambda s: F.trim(F.regexp_replace(s, r"^\s*##[A-Z0-9]+\.", ""))), lambda s: s != ""), lambda s: F.struct(s.alias("target_id"), F.upper(F.regexp_replace(x["t"], " ", "_")).alias("link_type")))))
    return found.select(F.col("r.0").alias("id"), "module", "heading", F.regexp_replace(F.regexp_replace(body, links, ""), r"\A\s+|\s+\z", "").alias("full_text"), ids.alias("outgoing_links"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A scored or summary table as CSV (header, quoted) or JSON lines; arrays of ids are joined for CSV."""
    if kind == "csv":
        flat = [join_ids(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").json(path)


def append_new(done: DataFrame | None, new: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows of new whose key isn't done yet."""
    if done is not None:
        new = new.join(done.select(*key).distinct(), [new[k].eqNullSafe(done[k]) for k in key], "left_anti")
    new.write.mode("append").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """current with the rows of changes put in place of those with the same key; a key twice in changes counts once."""
    once = changes.dropDuplicates(key)
    return current.join(once.select(*key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free hash of all rows: what an index compares before it is built again."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], str(r["h"])


def build_index(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write an index unless one of the same content is there. True if it was written."""
    spark = df.sparkSession
    if not force:
        try:
            if content_hash(spark.read.parquet(path).select(*df.columns)) == content_hash(df):
                return False
        except Exception as e:  # no index there, or one of other columns
            if "PATH_NOT_FOUND" not in str(e) and "UNRESOLVED_COLUMN" not in str(e):
                raise
    staged = written(df, "index")
    staged.write.mode("overwrite").parquet(path)
    return True
