"""Session helpers: configuration for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkpul")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` is used as is. Only a local-mode
    session without one (tests) gets a fresh folder; a cluster session without one is
    an error, since a machine-local folder is not shared by the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not str(sc.master).startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder shared by all executors"
            )
        # local mode only (tests): every task runs on this machine
        conf_dir = tempfile.mkdtemp(prefix="sparkpul-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage at files that every executor reaches, keeps column pruning and
    pushdown for what follows, and fixes columns that hang on the task.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a bucket, about; a scan has one task a bucket, however few its rows
BUCKET_ROWS = 4096


def materialize_bucketed(df, name: str, key: str, buckets: int | None = None):
    """Like ``materialize``, as a table hashed into buckets by ``key`` and sorted in them:
    one for ``BUCKET_ROWS`` rows, at most ``spark.sql.shuffle.partitions``.

    Joins on ``key`` with smaller tables read it where it lies: no exchange and no sort
    above its scan, however often it is joined. The table is external; its files are in the
    shared scratch folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // BUCKET_ROWS)
    writer = df.repartition(n, key).write.format("parquet").option("path", path)
    writer.bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def checkpoint(df):
    """Cut the lineage with a reliable checkpoint in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkpul`` importable in the Python workers of every executor.

    Functions that run in tasks (pandas UDFs, ``mapInPandas``, ``applyInPandas``)
    refer to this package by module name; the executors get it as a zip through
    ``addPyFile``, once per SparkContext. The zip is built on the driver and served
    to the executors by Spark (as ``--py-files`` does); no executor reads the
    driver's folder.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    # cells of a grid ask side by side; Spark refuses a second file of the name
    with _SHIPPING:
        if key in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        parent = os.path.dirname(pkg_dir)
        out_dir = tempfile.mkdtemp(prefix="sparkpul-py-")
        zpath = os.path.join(out_dir, "sparkpul.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, parent))
        sc.addPyFile(zpath)
        _SHIPPED.add(key)
