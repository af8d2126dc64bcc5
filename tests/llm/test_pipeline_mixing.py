"""The mixing stage keeps every document, however small the smallest source is."""

import corpus_pipeline
from tracelake.llm import mixing

SF = "/root/testdata/sf0.001"


def test_a_rare_source_drops_nothing(spark):
    rows = [(i, f"text {i}", "en", "rare" if i % 376 == 0 else None if i % 5 == 0 else "web", 9) for i in range(3008)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    mixed = mixing.mix_sources(df).collect()
    assert sum(not r["in_target"] for r in mixed) > 1500  # the rare source runs out early
    got = [r["doc_id"] for r in corpus_pipeline.mix_to_weights(spark, df, SF).collect()]
    assert got == [r["doc_id"] for r in sorted(mixed, key=lambda r: r["position"])]
    assert sorted(got) == list(range(3008))
