"""Agent threads in a stream's state: reducers, restarts, outputs sent twice."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.sources.keyed import KeyedTable
from tracelake.streaming import agent_state as A


def row(seq, chunks, tokens=None, need=3):
    return {"seq": seq, "chunks": chunks, "tokens": tokens, "need": need}


def test_reducers():
    assert A.add_chunks([3, 1], [1, 2, None, 2]) == [3, 1, 2] and A.add_chunks([], None) == []
    assert A.add_tokens({"a": 1}, {"a": 2, "b": None}) == {"a": 3, "b": 0} and A.add_tokens({"a": 1}, None) == {"a": 1}
    one = A.fold(None, [row(1, [5, 6], {"x": 2}), row(0, [5], {"x": 1})])
    assert one == (1, [5, 6], {"x": 3}, "continue", 2)
    assert A.fold(one, [row(1, [9]), row(2, [7], {"x": 1}), row(3, [8])]) == (2, [5, 6, 7], {"x": 4}, "sufficient", 2)
    assert A.fold(None, [row(0, [], None, 0)])[3] == "continue"  # nothing found is never enough


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    r = random.Random(2)
    every = [(q, s, [r.randint(0, 20) for _ in range(r.randint(0, 4))], {"in": r.randint(1, 9), f"m{q % 2}": 1}, 4 + q % 9) for q in range(40) for s in range(3)]
    inbox, state, checkpoint = (str(tmp_path / x) for x in ("inbox", "state", "checkpoint"))
    for s in range(3):
        part = [x for x in every if x[1] == s] + ([x for x in every if x[1] < s] if s == 2 else [])  # the last go sends all again
        spark.createDataFrame(part, A.OUTPUTS).repartition(3).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(A.OUTPUTS).parquet(inbox)
        A.keep_threads(stream, state, checkpoint).awaitTermination()
    got = {x["query_id"]: x for x in KeyedTable(spark, state).read().collect()}
    assert len(got) == 40
    for q in range(40):
        want = A.fold(None, [dict(zip(("query_id", "seq", "chunks", "tokens", "need"), x)) for x in every if x[0] == q])
        assert (got[q]["seq"], got[q]["chunks"], got[q]["tokens"], got[q]["verdict"], got[q]["iter_count"]) == want
