"""Lineage cuts through the cluster's shared folder, and size-checked broadcasts.

Iterative jobs and tables that are read more than once are written to the folder named by
``spark.checkpoint.dir``. That folder is visible to every executor, so a lost executor costs a
re-read, never a recomputation of the whole history.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a side may have before it is no longer sent to every executor.
BROADCAST_ROWS = 500_000
#: Bytes it may take.
BROADCAST_BYTES = 32 << 20

#: Where the shared folder is a local path: no checksum files and no marker of success. Without Hadoop's native library each of
#: them, as each file, starts a ``chmod``, which looks as large as the process it leaves until it runs.
PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}

#: Spark's switch for deleting an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share; a private one is set only where none is configured."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqrec-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def drop(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_seqrec_path", None)
    if path:
        _delete(spark, path)
        _made[:] = [x for x in _made if x[1] != path]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The result has no lineage, can be pruned by column and is cheap to read many times. What was shuffled for it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/seqrec/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        df.write.options(**PLAIN_FILES).parquet(path)
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqrec_path = path
    return out


def _weight(kind: T.DataType, column) -> tuple[int, object]:
    """Bytes that every value of a type takes, and what a value takes beyond, as a column (None: nothing)."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16, F.octet_length(column)
    if isinstance(kind, T.StructType):
        parts = [_weight(f.dataType, column.getField(f.name)) for f in kind.fields]
        more = [F.coalesce(p[1], F.lit(0)) for p in parts if p[1] is not None]
        return 16 + sum(p[0] for p in parts), sum(more[1:], more[0]) if more else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        held = _weight(kind.elementType, None)[0] if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 64
        return 16, F.greatest(F.size(column), F.lit(0)) * held
    return 8, None


def shuffled(df: DataFrame) -> DataFrame:
    """Mark ``df`` for a shuffle join: Spark takes a table after an explode for as small as the table before it, and broadcasts it by that."""
    return df.hint("merge")


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> bool:
    """Whether ``df`` is, counted, within ``limit`` rows and ``BROADCAST_BYTES``.

    The rows of a table of fixed-size columns may be given; texts and arrays are always measured.
    """
    parts = [_weight(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields]
    more = [F.coalesce(p[1], F.lit(0)) for p in parts if p[1] is not None]
    fixed, extra = 16 + sum(p[0] for p in parts), 0
    if more or rows is None:
        rows, extra = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(more[1:], more[0])) if more else F.lit(0), F.lit(0))).first()
    return rows <= limit and rows * fixed + extra <= BROADCAST_BYTES


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it :func:`fits`, else for a shuffle join."""
    return F.broadcast(df) if fits(df, limit, rows) else shuffled(df)
