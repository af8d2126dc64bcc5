"""What a search by the index hands on at once, however many cells a query is sent to."""

import numpy as np

from tracelake.operators import vectors
from tracelake.sources import vector_index


def test_small_pieces_give_the_same_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=16).tolist(), str(i % 3)) for i in range(1200)], "id long, vector array<double>, tag string")
    index, _ = vector_index.VectorIndex.build(rows, str(tmp_path / "i"), cells=90)
    asked = rows.filter("id % 3 = 0").selectExpr("id AS query_id", "vector", "tag")
    monkeypatch.setattr(vector_index, "STEP", 1600)
    monkeypatch.setattr(vectors, "MOST_COSINES", 500)
    got = index.search(asked, 5, match=True, exact=True).collect()
    want = vectors.top_k(asked, rows, 5, match=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_slices_hold_so_many_cosines():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["x"])
    parts = list(vector_index._slices(batch, 4096))
    assert max(p.num_rows for p in parts) * 4096 <= vector_index.STEP and sum(p.num_rows for p in parts) == 10_000
