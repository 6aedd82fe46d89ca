"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job needs regardless of cluster size. AQE coalesces small shuffle
# partitions and splits skewed join partitions at run time; ANSI stays on (Spark 4
# default), so the code uses try_divide / get where a value can be missing.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Streaming state (running token counts) off-heap with incremental checkpoints.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "docpairs", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster the directory must be a shared folder named by
    ``spark.checkpoint.dir``; it is read from the session and never invented.
    Only a local-mode session (tests, the single-node bench) without the setting
    gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running jobs that cut lineage")
    local_dir = tempfile.mkdtemp(prefix="docpairs-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return local_dir


def materialize(df, tag: str = "stage"):
    """Write ``df`` as Parquet into a fresh folder under the shared checkpoint
    directory and read it back: one job, lineage cut, and the result survives
    executor loss. (``Dataset.checkpoint`` would compute its input twice unless
    it were also persisted.)"""
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ensure_package_on_workers(spark: SparkSession) -> None:
    """Make ``docpairs`` importable in the Python workers (``mapInPandas`` and pandas
    UDF bodies refer to its functions). The package is zipped once per application
    into the shared checkpoint folder and added with ``addPyFile``; Spark ships it
    to every executor, including ones added later."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = ensure_checkpoint_dir(spark)
    local_root = root[len("file:"):] if root.startswith("file:") else root
    if "://" in local_root:
        # Shared storage that is not a local path: build the zip on the driver's
        # scratch space and let Spark distribute it from there.
        local_root = tempfile.mkdtemp(prefix="docpairs-pkg-")
    os.makedirs(local_root, exist_ok=True)
    zpath = os.path.join(local_root, f"docpairs-{app}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
