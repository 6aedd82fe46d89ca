"""Driver tables and the derived fixture views.

Every view is one SQL text for Spark SQL and DuckDB (only "one row per line" and "one row
per model" are spelled for each engine), so the Spark side and the DuckDB oracle start
from the same rows. The views only
re-shape the driver's parquet tables (documents, events, embeddings, customer);
their size grows with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Every line of every document, whole, with its place: the pairs and the evaluation texts
# are built from these same rows, so equal ids mean the same text. Each engine has its own
# spelling of "one row per line". No string of Spark has DOC_STEP characters, so no line
# reaches the ids of the next document and a "block" of that size is always a whole line.
DOC_STEP = 2147483647
PAIR_BLOCK = EVAL_BLOCK = DOC_STEP

LINES_SPARK = f"""(
  SELECT doc_id * {DOC_STEP} + line_no AS pair_id, lang, source, line
  FROM documents LATERAL VIEW posexplode(split(text, '\\n')) l AS line_no, line) doc_lines"""
LINES_DUCK = f"""(
  SELECT doc_id * {DOC_STEP} + line_no AS pair_id, lang, source, line
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) l) doc_lines"""

PAIRS_SQL = """
SELECT pair_id,
  CASE WHEN pair_id % 10 < 8 THEN 'train' WHEN pair_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
  lang AS language, source AS repo,
  source || '/m' || CAST(pair_id AS VARCHAR(20)) || '.py' AS path,
  CASE WHEN pair_id % 2 = 0 THEN 'get_' || lang || '_Item' ELSE 'loadHTTP' || lang || 'Row2' END AS func_name,
  CASE WHEN pair_id % 47 = 0 THEN NULL WHEN pair_id % 43 = 0 THEN '' ELSE
    'def ' || CASE WHEN pair_id % 2 = 0 THEN 'get_' || lang || '_Item' ELSE 'loadHTTP' || lang || 'Row2' END
    || '(a, b):' || chr(10) || chr(9) || 'x = a + b  ' || chr(10) || chr(10) || chr(10) || chr(10)
    || '    if x >= ' || CAST(pair_id % 7 AS VARCHAR(20)) || ':' || chr(10)
    || chr(9) || chr(9) || 'return "' || line || '"' || chr(10)
    || '  ' || chr(10) || '    return __x' || chr(10) || chr(10) END AS raw_code,
  CASE WHEN pair_id % 41 = 0 THEN NULL ELSE
    '\"\"\"' || CASE WHEN pair_id % 13 = 0 THEN 'TODO ' WHEN pair_id % 17 = 0 THEN 'Getter for ' ELSE '' END
    || line
    || CASE pair_id % 5
         WHEN 0 THEN chr(10) || '    Args:' || chr(10) || '        a: first'
         WHEN 1 THEN ' see https://ex.org/p?q=1 now'
         WHEN 2 THEN chr(10) || chr(9) || 'RETURNS: it'
         WHEN 3 THEN chr(160) || 'nb'
         ELSE '' END || '\"\"\"' END AS raw_doc
FROM {lines}
"""

EVAL_PAIRS_SQL = """
SELECT pair_id, m AS model, line AS reference,
  CASE WHEN m = 'alpha' AND pair_id % 4 = 0 THEN '  ' || replace(replace(line, 'e', 'E'), 'n', 'N') || ' '
       WHEN m = 'alpha' THEN replace(line, 'th', 'zz')
       WHEN pair_id % 31 = 0 THEN ''
       ELSE replace(replace(replace(line, ' the ', ' '), ' de ', ' '), ' die ', ' ') END AS prediction
FROM {lines} {models}
"""

PY_SOURCES_SQL = """
SELECT doc_id AS file_id, source || '/f' || CAST(doc_id AS VARCHAR(20)) || '.py' AS path,
  'import os' || chr(10)
  || CASE doc_id % 5 WHEN 0 THEN '@app.get("/x")' WHEN 1 THEN '@functools.cache' WHEN 2 THEN '@trace' WHEN 3 THEN '@reg[0]' ELSE '# plain' END || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'async def f' ELSE 'def f' END || CAST(doc_id AS VARCHAR(20)) || '(a, b=1, *c, d=2):' || chr(10)
  || '    \"\"\"' || replace(replace(replace(text, chr(10), ' '), chr(34), ''), chr(92), '')
  || CASE WHEN doc_id % 7 < 3 THEN chr(10) || '    more' || chr(10) || '    \"\"\"' WHEN doc_id % 7 < 5 THEN chr(10) || '    more\"\"\"' ELSE '\"\"\"' END || chr(10)
  || '    return a' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'class C(Base, x.Y):' ELSE 'class C(Generic[T], metaclass=M):' END || chr(10)
  || '    \"\"\"A class.\"\"\"' || chr(10) || '    def m(self): pass' || chr(10)
  || CASE WHEN doc_id % 29 = 0 THEN 'def (' ELSE '' END AS source_code
FROM documents
"""

# Whole documents as reference texts, with two whole-text "predictions".
EVAL_WHOLE_SQL = """
SELECT doc_id AS pair_id, m AS model, text AS reference,
  CASE WHEN m = 'alpha' THEN replace(text, 'th', 'zz') ELSE replace(text, 'e', 'E') END AS prediction
FROM documents {models}
"""

RUN_LOG_SQL = """
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY d) AS BIGINT) AS epoch, train_loss, val_loss
FROM (SELECT event_type AS run, CAST(date_trunc('day', ts) AS DATE) AS d,
        round(avg(CASE WHEN event_id % 2 = 0 THEN value END) / 50, 6) AS train_loss,
        round(avg(CASE WHEN event_id % 2 = 1 THEN value END) / 50, 6) AS val_loss
      FROM events GROUP BY event_type, CAST(date_trunc('day', ts) AS DATE)) l
"""

LOGITS_SQL = """
SELECT CAST(floor(vec_id / 128) AS BIGINT) AS batch_id, CAST(floor(vec_id / 16) AS BIGINT) AS seq_id,
  CAST(vec_id % 16 AS BIGINT) AS pos, CAST(label AS BIGINT) AS target, embedding AS logits
FROM embeddings
"""

REPOS_SQL = """
SELECT 'org/' || c_name AS name, 'https://ex.org/' || c_name AS url,
  CAST(floor(c_acctbal) AS BIGINT) AS stars,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'python' ELSE lower(c_mktsegment) END AS language
FROM customer
"""

# In Spark the two model rows come from exploding a literal array (a generator on each
# row) instead of a cross join with a two-row relation. Same rows.
MODELS_DUCK = "CROSS JOIN (SELECT 'alpha' AS m UNION ALL SELECT 'beta' AS m) models"
MODELS_SPARK = "LATERAL VIEW explode(array('alpha', 'beta')) models AS m"


def _spelled(sql: str, lines: str, models: str) -> str:
    return sql.replace("{lines}", lines).replace("{models}", models)


_BY_ENGINE = {"pairs": PAIRS_SQL, "eval_pairs": EVAL_PAIRS_SQL, "eval_whole": EVAL_WHOLE_SQL}
SPARK_VIEWS = {k: _spelled(v, LINES_SPARK, MODELS_SPARK) for k, v in _BY_ENGINE.items()}

VIEWS = {
    **{k: _spelled(v, LINES_DUCK, MODELS_DUCK) for k, v in _BY_ENGINE.items()},
    "py_sources": PY_SOURCES_SQL,
    "run_log": RUN_LOG_SQL,
    "logits": LOGITS_SQL,
    "repos": REPOS_SQL,
}

# Which driver tables each view reads; used to register only what a query needs.
VIEW_TABLES = {
    "pairs": ("documents",),
    "eval_pairs": ("documents",),
    "eval_whole": ("documents",),
    "py_sources": ("documents",),
    "run_log": ("events",),
    "logits": ("embeddings",),
    "repos": ("customer",),
}


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register the driver's parquet tables as temp views (lazy: no data is read)."""
    for name in names:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path) or "://" in sf_dir:
            spark.read.parquet(path).createOrReplaceTempView(name)


# Views whose rows feed CPU-heavy row-local work (regex cleaning, tokenising,
# n-gram metrics, parsing, losses).
SPREAD_VIEWS = ("pairs", "eval_pairs", "eval_whole", "py_sources", "logits")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when the input has fewer partitions than the cluster
    can run at once (e.g. a table stored as one row group). Planning only: no job
    runs to count partitions. A large, well-split input is returned unchanged, so
    at scale this adds no shuffle."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the tables in ``sf_dir``."""
    register_tables(spark, sf_dir, VIEW_TABLES[name])
    df = spark.sql(SPARK_VIEWS.get(name, VIEWS[name]))
    if name in SPREAD_VIEWS:
        df = spread(df)
    df.createOrReplaceTempView(name)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (for the DuckDB oracle)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"
