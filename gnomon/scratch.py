"""Intermediate tables in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names a folder that the driver and all executors can
reach.  Tables written there outlive any executor, so a stage that reads one
never has to recompute what lies before it.  The setting is read from the
session; only where it is unset and Spark runs on this machine alone (tests, a
laptop) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on a local master, one made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gnomon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gnomon/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where the list of tables written so far ends, for ``discard``."""
    return len(_written)


def discard(since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written since a mark, but for those with a name in ``keep``.

    For the end of an operator or a stage, when nothing that is still to be read
    depends on them any more.
    """
    for spark, path in _written[since:]:
        if not any(path.rsplit("/", 1)[1].startswith(f"{name}-") for name in keep):
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that a session has written."""
    for entry in [e for e in _written if e[0] is spark]:
        _delete(*entry)
        _written.remove(entry)


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
