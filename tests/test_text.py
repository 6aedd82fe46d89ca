"""Golden literals for cleaning, validity and tokenisation (FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from docpairs.functions import text as T
from one_column import one_col

DOC_CASES = [
    ('"""Sum two numbers.\n\n    Args:\n        a: x"""', "Sum two numbers."),
    ("Args: a b c", "Args: a b c"),
    ("See https://x.io/a for the docs", "See  for the docs"),
    ("  '''\"quoted\" text'''  ", '"quoted" text'),
    ("'\"x\"'", '"x"'),
    ("Compute it.\nnote: careful", "Compute it."),
    ("Compute it. Note: careful", "Compute it. Note: careful"),
    ("a\u00a0b\tc", "a b c"),
    ('""', ""),
    (None, ""),
    ("", ""),
]

CODE_CASES = [
    ("\tx = 1  \n\n\n\ny", "x = 1\n\ny"),
    ("a\n \n \n \nb", "a\n\n\n\nb"),
    ("a\r\nb  \n", "a\nb"),
    ("   ", ""),
]

TOKEN_CASES = [
    ("getUserName", ["get", "user", "name"]),
    ("get_userName", ["get", "username"]),
    ("HTTPServer2", ["h", "t", "t", "p", "server", "2"]),
    ("__init__", ["init"]),
    ("__", ["__"]),
    ("foo__bar_", ["foo", "bar"]),
    ("größe", ["gr", "e"]),
    ("ñ", ["ñ"]),
    ("a²b", ["a", "b"]),
    ("x+=1", ["x", "+", "=", "1"]),
    ("return Return", ["return", "return"]),
]


def test_clean_docstring(spark):
    df = one_col(spark, [c[0] for c in DOC_CASES])
    got = [r[0] for r in df.select(T.clean_docstring("x")).collect()]
    assert got == [c[1] for c in DOC_CASES]


def test_clean_code(spark):
    df = one_col(spark, [c[0] for c in CODE_CASES])
    got = [r[0] for r in df.select(T.clean_code("x")).collect()]
    assert got == [c[1] for c in CODE_CASES]


@pytest.mark.parametrize("code,doc,ok", [
    ("a b c", "w1 w2", False),
    ("a b c", "w1 w2 w3", True),
    ("a b", "w1 w2 w3", False),
    ("a b c", " ".join(["w"] * 128), True),
    ("a b c", " ".join(["w"] * 129), False),
    ("a b c", "TODO write this", False),
    ("a b c", "todos are listed here", False),
    ("a b c", "a todo list", True),
    ("", "w1 w2 w3", False),
])
def test_is_valid_pair(spark, code, doc, ok):
    df = spark.createDataFrame([(code, doc)], "c string, d string")
    assert df.select(T.is_valid_pair("c", "d")).first()[0] is ok


def test_reject_reason_order(spark):
    df = spark.createDataFrame([("", "x"), ("a b c", "x y"), ("a b", "TODO a b c")], "c string, d string")
    got = [r[0] for r in df.select(T.reject_reason("c", "d")).collect()]
    assert got == ["empty", "doc_too_short", "code_too_short"]


def test_tokenize_code(spark):
    df = one_col(spark, [c[0] for c in TOKEN_CASES])
    got = [r[0] for r in df.select(T.tokenize_code("x")).collect()]
    assert got == [c[1] for c in TOKEN_CASES]


def test_tokenize_code_raw_keeps_case(spark):
    df = one_col(spark, ["getUserName(a_b)"])
    assert df.select(T.tokenize_code("x", False)).first()[0] == ["getUserName", "(", "a_b", ")"]


def test_tokenize_text_drops_empties(spark):
    df = one_col(spark, ["  Hello World \n"])
    assert df.select(T.tokenize_text("x")).first()[0] == ["hello", "world"]


def test_strip_specials_keeps_duplicates(spark):
    df = spark.createDataFrame([(["<SOS>", "a", "a", "<UNK>", "b", "<EOS>", "<PAD>"],)], "t array<string>")
    assert df.select(T.join_tokens(T.strip_specials("t"))).first()[0] == "a a b"


def test_rouge_tokens(spark):
    df = one_col(spark, ["Hello, World! x-ray 42"])
    assert df.select(T.rouge_tokens("x")).first()[0] == ["hello", "world", "x", "ray", "42"]
