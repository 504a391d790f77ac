"""Tables that cut lineage, in the folder that all executors share.

A checkpoint would compute its input twice; a written table does so once. The folder is the session's
``spark.checkpoint.dir``. Only a local session, whose executors are this process, may do without: it gets
a temporary folder. On a cluster that folder would be another one on every machine, so it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []  # the folder of local sessions that name none


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="gatelight-"))
        found = _own[0]
    return found.rstrip("/")


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the table read back; ``by`` splits it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/gatelight-{uuid.uuid4().hex}"
    _written.append((spark, path))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session has ended, and its folder goes with it
        return


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """Keep what ``make`` returns, and delete the tables that were kept on the way to it."""
    start = len(_written)
    out = keep(make())
    for spark, path in _written[start:-1]:
        _delete(spark, path)
    del _written[start:-1]
    return out


@atexit.register
def drop(since: int = 0) -> None:
    """Delete what was kept. Only for callers whose results are already written."""
    while len(_written) > since:
        _delete(*_written.pop())
