"""The order of the mix reaches the sequences."""

import corpus_pipeline
from tracelake.llm import common

SF = "/root/testdata/sf0.001"


def test_sequences_follow_the_mix(spark):
    rows = [(i, f"text {i} of {i * 77 % 600} words", "en", "rare" if i % 6 == 0 else "web", 9) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    mixed = corpus_pipeline.mix_to_weights(spark, df, SF).coalesce(1)
    place = {r["doc_id"]: i for i, r in enumerate(mixed.collect())}
    assert len(place) == 700
    for docs in (common.written(mixed, "mixed"), mixed):
        pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
        got = [place[r["doc_id"]] // corpus_pipeline.WINDOW for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))]
        assert got == sorted(got) and len(set(got)) == 6
