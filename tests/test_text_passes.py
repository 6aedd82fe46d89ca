"""Words are cut without one copy of the text per match, and by Python's whitespace."""

import re

from docpairs.functions import text as T


def test_words_and_marks(spark):
    texts = ["", "  ", "a_b  c+=d　e f (g)", "\x1c x  y ", "é\U0001f600ß٣_1 \t\n.."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    cut = df.select("t", T.raw_code_tokens("t").alias("code"), T.whitespace_tokens("t").alias("words"), T.word_count("t").alias("n"), T.strip_ws("t").alias("s"))
    assert "regexp_extract_all" not in cut._jdf.queryExecution().optimizedPlan().toString()
    for r in cut.collect():
        assert r.code == re.findall(r"\w+|[^\w\s]", r.t)
        assert r.words == r.t.split() and r.n == len(r.words) and r.s == r.t.strip()
