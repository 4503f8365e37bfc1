"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that are being written within each open scratch().
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session of one machine may leave it unset: a folder is then made, once."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quire-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """The path of a table to be written in the shared folder."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read back: what follows does not compute it again, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes the table that stored() wrote for df. Nothing that is not written yet may depend on it."""
    _delete(df.sparkSession, df._stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession, kept: list[DataFrame]) -> Iterator[None]:
    """Deletes at its end all tables that stored() wrote within, but for those of the frames in `kept`, which may be filled within."""
    _open.append([])
    try:
        yield
    finally:
        for path in set(_open.pop()) - {df._stored_at for df in kept}:
            _delete(spark, path)
