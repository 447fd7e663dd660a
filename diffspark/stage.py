"""Stage tables: results written once to shared storage and read back.

A stage table cuts lineage (a lost executor re-reads files instead of re-running
everything upstream), fixes values that must not change between two uses (range
bucket ids), and gives the optimizer the real size of the table, so that the
automatic broadcast threshold acts on measured bytes and larger tables fall back to a
shuffle join.

The folder must be one that driver and executors share; only in local mode, where they are
one process, a private one serves. Stage tables stay until :func:`stage_scope` or the owner of
the folder removes them. The shuffle files behind a stage table go as soon as it is written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}
_SCOPES: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A task holds a row group and a page of each column: they are cut by their bytes, also where rows are
# so large that the usual first look after a hundred rows is late.
ROW_GROUPS = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "4",
    "parquet.page.size.row.check.min": "4",
}


def stage_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir`` or set as the checkpoint folder of the
    context; in local mode, where neither is set, a private one."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = context.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = tempfile.mkdtemp(prefix="diffspark-stage-")
    return _OWN_ROOTS[app]


def new_path(spark: SparkSession) -> str:
    """Path for a new stage table; the innermost open scope removes what is put there."""
    path = f"{stage_root(spark)}/diffspark/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def write_stage(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write ``df`` under a path of :func:`new_path`, in folders of the columns ``by``; what the write
    has shuffled is removed when it ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**ROW_GROUPS).partitionBy(*by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a stage table and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark)
    write_stage(df, path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Stage table of what ``build`` returns; the stage tables that it made on the way are removed."""
    path = new_path(spark)
    with stage_scope(spark):
        df = build()
        write_stage(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stage(spark: SparkSession, path: str) -> None:
    """Remove a stage table, or a folder of one, that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Stage tables made inside are removed at the end: use a result before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_stage(spark, path)
