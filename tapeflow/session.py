"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on: UTC, so NTZ inputs and epoch math agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(app: str = "tapeflow", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def one_machine(spark: SparkSession) -> bool:
    """Do the driver and all executors run on this machine, so that its folders are shared?

    A local master runs in one process and a ``local-cluster`` on one machine; with a driver on a loopback address no executor of
    another machine could reach it.
    """
    local = re.fullmatch(r"local(-cluster)?(\[.*\])?", spark.conf.get("spark.master", ""))
    return local is not None or re.fullmatch(r"localhost|127(\.\d+){3}", spark.conf.get("spark.driver.host", None) or "") is not None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables: the cluster's own.

    Only on one machine may the setting be a path without a scheme, or be missing, which gives a new folder. Elsewhere a folder of
    one machine would lose the files of all others, so both are errors there.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    local = one_machine(spark)
    if not configured and local:
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, configured)
    if not configured or not (local or "://" in configured or configured.startswith("file:/")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a URI that all executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Tables staged by this process, by application.
_STAGED: dict[str, list[str]] = defaultdict(list)


def staged(df: DataFrame, **options: str | int) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back.

    For inputs read several times in one plan: the costly part before it runs
    once, survives lost executors, and columns are still pruned on each read.
    ``release`` deletes what was staged once its results are no longer read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _STAGED[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this process staged for the session; frames read from them end here."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
