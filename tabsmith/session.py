"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "tabsmith",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass
    ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster is expected to set it to a shared file system; outside local
    mode an unset folder is an error, because a folder of the driver's machine
    is not visible to the executors.  In local mode (tests) a private folder is
    created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="tabsmith-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables.

    The scheme of the folder is kept, so the path means the same store on the
    driver and on every executor.
    """
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting that frees the shuffle files of a finished SQL execution.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bound on one Arrow batch, 64 MB by default: a task holds a batch in the JVM and again in Python.
_BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


_guard = threading.Lock()
#: By setting, the writes under way and the session's own choice before the first of them.
_writes: dict = {key: {"open": 0, "before": None} for key in (_FREE_SHUFFLES, _BATCH_BYTES)}


@contextmanager
def _while_writing(spark: SparkSession, key: str, value: str):
    """Hold a setting while any write that needs it is under way; writes of several threads share it."""
    held = _writes[key]
    with _guard:
        if held["open"] == 0:
            held["before"] = spark.conf.get(key, None)
            spark.conf.set(key, value)
        held["open"] += 1
    try:
        yield
    finally:
        with _guard:
            held["open"] -= 1
            if held["open"] == 0:
                if held["before"] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held["before"])


@contextmanager
def small_batches(spark: SparkSession):
    """What is written meanwhile reaches its ``mapInArrow`` functions in batches of about ``SMALL_BATCH`` bytes, or of one row."""
    with _while_writing(spark, _BATCH_BYTES, SMALL_BATCH):
        yield


def written(df: DataFrame, name: str, small_batches: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads finished files, so a lost executor
    never recomputes what stands before.  Nothing reads the shuffle files of the
    write again, so they are freed with it instead of staying on the executors'
    disks until the session ends; the session's own choice is put back after the
    last write under way.  With ``small_batches`` the rows of ``df`` reach its
    ``mapInArrow`` functions in batches of about ``SMALL_BATCH`` bytes, or of one row.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _while_writing(spark, _FREE_SHUFFLES, "true"):
        with _while_writing(spark, _BATCH_BYTES, SMALL_BATCH) if small_batches else nullcontext():
            df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again: what was made of them is written itself.

    Frames that are still lazily built on them must not be used afterwards."""
    for table in tables:
        path = getattr(table, "_written_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
