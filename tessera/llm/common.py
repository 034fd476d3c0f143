"""What the operators share: durable intermediate tables, names, small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns may be broadcast (about 10 MB).
BROADCAST_ROWS = 100_000
#: Removes a query's shuffle files when it ends; tables made on the way to a result aren't read by the same query again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that the innermost ``settled`` has made so far; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a
    cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    _note(_checkpoint_path(out))
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: lineage ends there, and columns that aren't asked for aren't read."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    return df.sparkSession.read.parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, durable; other tables made on the way by ``durable`` and ``written`` are deleted.

    So ``make`` must not hand out tables in other ways.  Shuffle files are
    removed after each query on the way.  May be nested.
    """
    before, mine = spark.conf.get(CLEANUP, "false"), []
    token = _made.set(mine)
    spark.conf.set(CLEANUP, "true")
    try:
        out = durable(make())
    finally:
        spark.conf.set(CLEANUP, before)
        _made.reset(token)
    kept = _checkpoint_path(out)
    for path in mine:
        if path != kept:
            _delete(spark, path)
    _note(kept)
    return out


def _note(path: str) -> None:
    made = _made.get()
    if made is not None:
        made.append(path)


def _checkpoint_path(df: DataFrame) -> str:
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table counted to have at most ``most`` rows; above that, none.

    ``df`` should be durable, as it is counted here.
    """
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in have:
        name = f"_{stem}_{uuid.uuid4().hex[:8]}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def many_partitions(df: DataFrame, *keys) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
