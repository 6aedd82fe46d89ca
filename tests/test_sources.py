"""Sources that break: files that cannot be opened, that break off, splits that are missing."""

from docpairs.sources import io
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("docstring", T.StringType())])


def test_broken_files_leave_the_others(spark, tmp_path):
    for k, split in enumerate(("train", "test")):
        rows = spark.range(k * 1000, k * 1000 + 40, 1, 4).select(F.col("id").alias("pair_id"), F.lit("c").alias("code"), F.lit("d").alias("docstring"))
        rows.write.parquet(f"{tmp_path}/{split}")
    files = sorted((tmp_path / "train").glob("*.parquet"))
    whole = files[0].read_bytes()
    files[0].write_bytes(whole[:len(whole) // 2])        # cut off: no footer
    files[1].write_bytes(b"")                            # empty
    broken = bytearray(files[2].read_bytes())            # the footer is whole, the pages are not
    broken[4:60] = bytes(56)
    files[2].write_bytes(bytes(broken))
    pairs, told = io.load_split_sources(spark, {"train": f"{tmp_path}/train", "validation": f"{tmp_path}/no", "test": f"{tmp_path}/test"}, schema=SCHEMA)
    ids = {r.pair_id for r in pairs.collect()}
    assert {i for i in ids if i >= 1000} == set(range(1000, 1040)) and {i for i in ids if i < 1000} == set(range(30, 40))
    got = {(r.split, r.file.rsplit("/", 1)[1]): r.whole for r in told.collect()}
    assert len(got) == 8 and {k[1] for k, ok in got.items() if not ok} == {f.name for f in files[:3]}


def test_without_a_schema_a_missing_split_is_empty(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("pair_id"), F.lit("c").alias("code")).write.parquet(f"{tmp_path}/train")
    pairs = io.load_split_sources(spark, {"train": f"{tmp_path}/train", "test": f"{tmp_path}/no"})
    assert {(r.split, r.pair_id) for r in pairs.collect()} == {("train", i) for i in range(5)}
