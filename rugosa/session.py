"""Session helpers: a local session for tests/bench and a checkpoint helper
that honours the cluster's ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local[N] session configured the way the library expects a cluster to be."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rugosa")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RUGOSA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local master may leave it
    unset (tests); it then gets a fresh scratch folder. On a cluster a folder of
    one machine would lose data, so there it is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    path = tempfile.mkdtemp(prefix="rugosa-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, checkpoint: bool = False) -> DataFrame:
    """Pin a table that several jobs read.

    ``checkpoint=True`` writes it to the shared checkpoint folder (cuts the
    lineage, survives executor loss without recomputation); otherwise it is
    persisted memory-and-disk and recomputed from lineage if lost.
    """
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        # persist first: writing a reliable checkpoint otherwise computes the
        # input twice (once for the job, once for the checkpoint writer)
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist(blocking=False)
        return out
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Pin a large table that several jobs read: written once as Parquet to the shared
    checkpoint folder, so that no job reads columns it has no use for and nothing of
    it stays in the executors' memory."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rugosa-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle that nothing can read again once the driver's
    JVM collects its garbage, which may not happen for hours: let it collect now."""
    import gc

    gc.collect()   # Python objects hold the JVM's
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rugosa`` importable in the executors' Python workers (pandas
    UDFs and ``mapInPandas`` functions reference it). The package is zipped
    once per SparkContext and distributed with ``addPyFile``, as for any
    Python library shipped to a cluster."""
    import zipfile

    import rugosa

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(rugosa.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="rugosa-pkg-"), "rugosa.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
