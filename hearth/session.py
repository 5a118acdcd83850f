"""Session helpers: a local session for tests/bench and the shared folder
used to cut lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "hearth") -> SparkSession:
    """Session for tests and the local benchmark. On a cluster, build the
    session with the cluster's own settings instead; the operators only rely
    on AQE being on (the default since Spark 3.2)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HEARTH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers (pandas UDF tasks) by
    shipping a zip of it with the job, once per Spark application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="hearth-code-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; only a local master (a test or a
    laptop) gets a fresh folder of its own when nothing is configured. On a
    cluster without the setting this raises: a machine-local folder would be
    a different one on every executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        ship_package(spark)
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hearth-ckpt-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    ship_package(spark)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, for tables
    that are written and read back (sinks in round trips, lineage cuts)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/hearth-{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``shared_path`` named, through the file system
    that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as parquet in the shared checkpoint folder and read
    it back: the job restarts from there after an executor loss, the plan
    stays short in iterative loops, and the re-read plan carries the real
    file size (a reliable ``checkpoint()`` keeps the original plan's size
    estimate, which multiplies through every later join). Never a local
    checkpoint."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
