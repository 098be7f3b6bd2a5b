"""Tables written to the folder all executors share, to cut lineage in loops.

The folder is ``spark.checkpoint.dir``. Only a local session without that setting
(tests, a laptop) gets a temporary folder of its own; on a cluster its absence is an error, as
executors don't share the driver's disk. A written table survives
the loss of any executor, and reads of it prune columns.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quern-")
    return f"file://{_LOCAL[app]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    path = getattr(df, "_quern_path", None)
    if path:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _WRITTEN:
        try:
            _drop(spark, path)
        except Exception:  # the session may be gone at exit
            return
