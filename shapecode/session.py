"""Session helpers: a tuned local session for tests/bench and checkpoint setup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "shapecode") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    A master and a shuffle width named by spark-submit (or by the defaults
    file) stay as they are unless the caller asks for others; only where no
    master is named we pick ``local[$BENCH_CPUS]`` with as many shuffle
    partitions as cores.
    """
    from pyspark import SparkConf

    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    named = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master or not named.contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
        shuffle_partitions = shuffle_partitions or cpus
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SHAPECODE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", "128m")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we use it and
    raise an error where a cluster names none.  Only a local master, whose
    executors share the driver's disk, gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="shapecode-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable (shared-storage) checkpoint; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shapecode`` importable in Python workers (``--py-files`` equivalent).

    Arrow stages (``mapInPandas``) run functions of this package on the
    executors; when the job was not submitted with the package on
    ``--py-files``, zip it once per application and add it to the context.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="shapecode-pyfiles-"), "shapecode.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
