"""Judges' texts: the outermost object against a plain pattern, and how often a text is parsed."""

import random
import re

from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import judging


def test_outermost_object(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("{}}{ab\n é😀") for _ in range(r.randint(0, 9))) for _ in range(600)] + [None, "", "}{", "{}", "a{b}c}d{"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in df.select("t", text.first_json(F.col("t"), outermost=True).alias("j")).collect():
        m = re.search(r"\{[\s\S]*\}", x["t"] or "")
        assert x["j"] == (m.group() if m else None), x["t"]


def test_a_text_is_read_once(spark):
    rows = spark.createDataFrame([("q", "p", 0, "j", '{"faithful": true, "reason": "r"}', 5)], "query string, pipeline string, repeat int, judge string, raw string, n long")
    df = judging.answered(rows, "2026-05-11", tokens="n")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 3  # the whole, the verdict, the reason
    assert tuple(df.first())[5:] == (True, "r", 5, None)
