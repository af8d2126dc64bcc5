"""Agent threads as keyed state of a stream: what nodes of the agent put out is folded into one state a thread, by reducers.

A row of the stream is one output of a node: query_id (the thread), seq (its place in the thread), chunks it found, tokens it used (a
map by model or kind), and need, the number of chunks that the critic asks for. The reducers: chunks are appended, each once, in the
order first seen; token maps are added up. After each output the verdict is sufficient if the thread has as many chunks as are needed,
else continue (and iter_count counts those); a thread that has enough takes no more outputs, nor does any thread one whose seq it has
passed, so an output that is sent again changes nothing. State lives in Spark's state store beside the stream's checkpoint: a query that
was stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.keyed import KeyedTable

OUTPUTS = "query_id long, seq long, chunks array<long>, tokens map<string,long>, need long"
_STATE = "seq long, chunks array<long>, tokens map<string,long>, verdict string, iter_count int"
THREADS = f"query_id long, {_STATE}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def add_chunks(old: list[int], new: list[int] | None) -> list[int]:
    return list(dict.fromkeys([*old, *(x for x in new or () if x is not None)]))


def add_tokens(old: dict[str, int], new: Any) -> dict[str, int]:
    """new: a map, or its pairs, as Arrow gives them."""
    return {**old, **{k: old.get(k, 0) + (v or 0) for k, v in dict(new or ()).items()}}


def fold(state: tuple | None, outputs: list[Any]) -> tuple:
    """A thread's state (seq, chunks, tokens, verdict, iter_count) after outputs, in order of their seq."""
    seq, chunks, tokens, verdict, count = state or (-1, [], {}, "continue", 0)
    for r in sorted(outputs, key=lambda r: r["seq"]):
        if r["seq"] <= seq or verdict == "sufficient":
            continue
        seq, chunks, tokens = r["seq"], add_chunks(chunks, r["chunks"]), add_tokens(tokens, r["tokens"])
        verdict = "sufficient" if chunks and len(chunks) >= (r["need"] or 0) else "continue"
        count += verdict == "continue"
    return seq, chunks, tokens, verdict, count


class Threads(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("thread", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = None
        if self._state.exists():
            s = self._state.get()
            old = (s[0], list(s[1]), dict(s[2]), s[3], s[4])
        new = fold(old, list(rows))
        self._state.update(new)
        yield Row(query_id=key[0], seq=new[0], chunks=new[1], tokens=new[2], verdict=new[3], iter_count=new[4])

    def close(self) -> None:
        pass


def thread_states(outputs: DataFrame) -> DataFrame:
    """The states of the threads that a batch of the stream outputs (OUTPUTS) has touched, as THREADS."""
    return outputs.groupBy("query_id").transformWithState(Threads(), THREADS, "Update", "None")


def keep_threads(outputs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes what is there (available-now) and keeps each thread's last state in the keyed table at path. A batch
    that is run again after a failure puts the same rows there again."""
    spark: SparkSession = outputs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        at = s._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta")
        if at.getFileSystem(s._jsc.hadoopConfiguration()).exists(at):
            KeyedTable(s, path).upsert(batch)
        else:
            KeyedTable.create(batch, path, ["query_id"], buckets=16)

    states = thread_states(outputs)
    return states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
