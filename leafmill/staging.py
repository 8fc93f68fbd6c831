"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, else one in the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_leafmill"
    return _ROOTS[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage; ``release`` deletes it."""
    path = f"{shared_root(df.sparkSession)}/leafmill-{uuid.uuid4().hex[:12]}-{name}"
    _STAGED.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete what was staged; called when the driver ends, or by a long-lived driver between jobs."""
    for spark, path in _STAGED:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended already  # noqa: BLE001
            break
    _STAGED.clear()
