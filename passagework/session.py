"""Session helpers: defaults for tests and benches, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app_name: str = "passagework", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single-machine benches. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        # an encoder has much work per byte: more tasks than bytes alone would give
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix=f"{app_name}-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table, in the folder all executors share.

    The session names that folder in ``spark.checkpoint.dir``. Only on a local
    master, where driver and executors are one machine, is one made where none
    is named. What is written there goes away when the application ends.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="passagework-")
        spark.conf.set(CHECKPOINT_CONF, root)
        _removed_at_exit(spark, root)
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _removed_at_exit(spark, folder)
    return f"{folder}/data"


def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
