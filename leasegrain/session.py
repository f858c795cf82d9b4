"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "leasegrain", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_own_folder: dict[str, str] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder. On a
    cluster a machine-local folder would be lost with its executor, so there
    the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="leasegrain-")
    return _own_folder[app]


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each is done.

    Otherwise they stay until the driver happens to collect its garbage, so that
    a job of many tables holds the shuffles of all of them on disk.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVE_SHUFFLES) if before is None else spark.conf.set(_REMOVE_SHUFFLES, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where several results read one expensive frame: the work is done
    once, survives the loss of executors, and the reader prunes columns and
    sees true sizes when it picks join strategies.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leasegrain-tables/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``staged`` wrote, once no frame that is still to run reads it.

    Any other frame stays as it is.
    """
    path = _path_of.pop(table, None)
    if path is not None:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
