"""What the operators of this subpackage share: reading tables, staging intermediate tables, fresh names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a staged table of few narrow columns is broadcast; rows from which a key counts as hot.
BROADCAST_ROWS, HOT = 500_000, 1000
#: Parts of which a key that may be hot is dealt.
SALTS = 64

_ROOTS: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{base}_{n}"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, which driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local master
    gets a temporary folder and any other master a folder in the warehouse, which is shared as well.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_leafmill"
    return _ROOTS[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/leafmill-{uuid.uuid4().hex[:12]}-{name}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without recomputing ``df``, and several
    consumers read it without computing it again. The files stay until the session ends, as results are lazy.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a staged table of few narrow columns, marked for broadcast if it is small; else joins with it shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def salted(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, of which one value may have most of the rows of ``left``.

    Rows of a key are dealt in ``SALTS`` parts by a hash of the column ``spread``, and each row of ``right`` (one a key)
    goes to all of them. For right sides that have far fewer rows than the left.
    """
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread, F.lit(5)), F.lit(SALTS)).cast("int")).join(many, [key, "__salt"], how).drop("__salt")


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """``left`` joined with the staged ``right`` on ``key``, which has one row a key and tells in ``count`` how many ``left`` has of it.

    Hot keys, of which there are at most ``left``'s rows by ``HOT``, do not shuffle ``left`` if they are few enough to be broadcast.
    """
    hot = stage(right.where(F.col(count) > HOT), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    few = small(hot)
    return left.join(few, key).unionByName(left.join(few.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(right.where(F.col(count) <= HOT), key))


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    if path := getattr(df, "_leafmill_path", None):
        drop_path(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


@atexit.register
def release() -> None:
    """Delete the staged tables; called when the driver ends, or by a long-lived driver between jobs."""
    for spark, path in _STAGED:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended already  # noqa: BLE001
            break
    _STAGED.clear()
