"""Property test: the Java-regex column functions and their RE2 (DuckDB) spellings
agree on random strings built from a hostile alphabet."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docpairs.functions import text as T
from docpairs.plans import duck as D

PIECES = ["a", "Z", "ß", "é", "ñ", "2", "²", "_", "__", "x_y", "getUserName", "HTTPServer", " ", "  ", "\t",
          "\n", "\n\n\n", "\r\n", "\u00a0", "\u2003", "\u3000", "\x1c", '"', '"""', "'", "'''", "Args:",
          "\n    Returns:", "\nnote:", "Examples:", "https://ex.org/a?b=1", "http://x", "TODO", "todo ",
          "getter for", "+", "=", "(", ")", ".", ",", "é", "Ω"]

texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=30, max_size=30)


def _duck(values, exprs):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    sel = ", ".join(f"{e} AS c{k}" for k, e in enumerate(exprs))
    return [tuple(r[1:]) for r in con.execute(f"SELECT i, {sel} FROM t ORDER BY i").fetchall()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_cleaning_and_tokens_agree(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    spark_rows = [tuple(r[1:]) for r in df.select(
        "i", T.clean_docstring("x"), T.clean_code("x"), T.join_tokens(T.tokenize_code("x")),
        T.join_tokens(T.tokenize_code("x", False)), T.join_tokens(T.tokenize_text("x")),
        T.join_tokens(T.rouge_tokens("x")), T.word_count("x").cast("bigint"),
        T.reject_reason(T.clean_code("x"), T.clean_docstring("x"))).orderBy("i").collect()]
    duck_rows = _duck(values, [
        D.clean_docstring("x"), D.clean_code("x"), D.join_tokens(D.tokenize_code("x")),
        D.join_tokens(D.tokenize_code("x", False)), D.join_tokens(D.tokenize_text("x")),
        D.join_tokens(D.rouge_tokens("x")), D.word_count("x"),
        D.reject_reason(D.clean_code("x"), D.clean_docstring("x"))])
    assert spark_rows == duck_rows
