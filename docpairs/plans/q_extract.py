"""Definition-extraction queries (X1-X6, S5) over ``py_sources``.

The oracle needs no parser: the fixture's files are built from a formula, so the
expected definition rows are written as SQL over ``documents`` (FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..session import ensure_checkpoint_dir
from ..sources import fixtures
from ..sources.files import fresh_folder, write_files
from .common import oracle
from .registry import register

_EXPECTED = (
    "src AS (SELECT doc_id, source || '/f' || CAST(doc_id AS VARCHAR(20)) || '.py' AS path, "
    "replace(replace(replace(text, chr(10), ' '), chr(34), ''), chr(92), '') AS body, "
    "doc_id % 7 AS k7, doc_id % 5 AS k5, "
    "CASE WHEN doc_id % 3 = 0 THEN 'async def f' ELSE 'def f' END || CAST(doc_id AS VARCHAR(20)) || '(a, b=1, *c, d=2):' AS def_line, "
    "CASE WHEN doc_id % 2 = 0 THEN 'class C(Base, x.Y):' ELSE 'class C(Generic[T], metaclass=M):' END AS class_line, "
    "CASE WHEN doc_id % 2 = 0 THEN 'Base,x.Y' ELSE 'unknown' END AS bases "
    "FROM documents WHERE doc_id % 29 <> 0)",
    "fn AS (SELECT CAST(doc_id AS BIGINT) AS file_id, path, 'function' AS type, 'f' || CAST(doc_id AS VARCHAR(20)) AS name, "
    "CASE WHEN k7 IN (3, 4) THEN def_line ELSE def_line || chr(10) || '    return a' END AS code, "
    "CASE WHEN k7 < 5 THEN ltrim(body) || chr(10) || 'more' ELSE trim(body) END AS docstring, "
    "'a,b' AS args, CAST(3 AS BIGINT) AS line_number, "
    "CASE k5 WHEN 0 THEN 'get' WHEN 1 THEN 'functools.cache' WHEN 2 THEN 'trace' WHEN 3 THEN 'unknown' ELSE '' END AS decorators, "
    "CAST(NULL AS VARCHAR) AS methods, CAST(NULL AS VARCHAR) AS bases FROM src WHERE trim(body) <> '')",
    "cl AS (SELECT CAST(doc_id AS BIGINT) AS file_id, path, 'class' AS type, 'C' AS name, "
    "class_line || chr(10) || '    \"\"\"A class.\"\"\"' || chr(10) || '    def m(self): pass' AS code, "
    "'A class.' AS docstring, CAST(NULL AS VARCHAR) AS args, "
    "CAST(6 + CASE WHEN k7 < 3 THEN 2 WHEN k7 < 5 THEN 1 ELSE 0 END AS BIGINT) AS line_number, "
    "CAST(NULL AS VARCHAR) AS decorators, 'm' AS methods, bases FROM src)",
    "defs AS (SELECT *, CAST(0 AS BIGINT) AS ord FROM fn UNION ALL "
    "SELECT *, CAST(CASE WHEN file_id IN (SELECT file_id FROM fn) THEN 1 ELSE 0 END AS BIGINT) AS ord FROM cl)",
)


def _defs(spark, sf_dir):
    return X.extract(fixtures.view(spark, sf_dir, "py_sources"))


def _flat(df):
    return df.select("file_id", "path", "ord", "type", "name", "code", "docstring",
                     F.array_join("args", ",").alias("args"), "line_number",
                     F.array_join("decorators", ",").alias("decorators"),
                     F.array_join("methods", ",").alias("methods"), F.array_join("bases", ",").alias("bases"))


@register("extract_definitions", oracle(
    "SELECT file_id, path, ord, type, name, code, docstring, args, line_number, decorators, methods, bases FROM defs",
    *_EXPECTED, views=()))
def q_extract_definitions(spark, sf_dir):
    return _flat(_defs(spark, sf_dir).where(F.col("type") != "error"))


@register("extract_errors", oracle(
    "SELECT CAST(doc_id AS BIGINT) AS file_id, source || '/f' || CAST(doc_id AS VARCHAR(20)) || '.py' AS path, "
    "'SyntaxError' AS error FROM documents WHERE doc_id % 29 = 0", views=()))
def q_extract_errors(spark, sf_dir):
    return _defs(spark, sf_dir).where(F.col("type") == "error").select("file_id", "path", "error")


@register("class_inventory", oracle(
    "SELECT file_id, name, methods, bases, line_number FROM defs WHERE type = 'class'", *_EXPECTED, views=()))
def q_class_inventory(spark, sf_dir):
    d = _defs(spark, sf_dir).where(F.col("type") == "class")
    return d.select("file_id", "name", F.array_join("methods", ",").alias("methods"),
                    F.array_join("bases", ",").alias("bases"), "line_number")


@register("strip_docstring", oracle(
    "SELECT file_id, name, code FROM defs WHERE type = 'function'", *_EXPECTED, views=()))
def q_strip_docstring(spark, sf_dir):
    return _defs(spark, sf_dir).where(F.col("type") == "function").select("file_id", "name", "code")


@register("decorator_usage", oracle(
    "SELECT decorator, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(decorators, ',')) AS decorator "
    "FROM defs WHERE type = 'function' AND decorators <> '') x GROUP BY decorator", *_EXPECTED, views=()))
def q_decorator_usage(spark, sf_dir):
    d = _defs(spark, sf_dir).where(F.col("type") == "function")
    return (d.select(F.explode("decorators").alias("decorator")).groupBy("decorator")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("class_bases", oracle(
    "SELECT base, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(bases, ',')) AS base "
    "FROM defs WHERE type = 'class' AND bases <> '') x GROUP BY base", *_EXPECTED, views=()))
def q_class_bases(spark, sf_dir):
    d = _defs(spark, sf_dir).where(F.col("type") == "class")
    return d.select(F.explode("bases").alias("base")).groupBy("base").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# The fixture files written by the tasks into the shared checkpoint folder (many
# files per folder), read back with the binaryFile source, then extracted.
@register("extract_from_files", oracle(
    "SELECT file_id, ord, type, name, line_number FROM defs", *_EXPECTED, views=()))
def q_extract_from_files(spark, sf_dir):
    out = fresh_folder(ensure_checkpoint_dir(spark), "py-sources")
    write_files(fixtures.view(spark, sf_dir, "py_sources"), out, "file_id", "source_code")
    files = X.read_source_files(spark, out)
    files = files.withColumn("file_id", F.regexp_extract("path", r"/(\d+)\.py$", 1).cast("bigint"))
    defs = X.extract(files)
    return defs.where(F.col("type") != "error").select("file_id", "ord", "type", "name", "line_number")
