"""A run log as a stream: each micro-batch appends the runs whose key isn't in the log yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import pending


def append_stream(runs: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Start a query that takes what is there (available-now) and appends new runs to Parquet at path. A batch that is run again
    after a failure finds its own rows and appends none twice."""

    def put(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(key)
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = pending(new, spark.read.schema(batch.schema).parquet(path), key)
        new.write.mode("append").parquet(path)

    return runs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
