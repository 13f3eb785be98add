"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on this machine (tests, notebooks)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "local" not in _OWN:
        _OWN["local"] = "file://" + tempfile.mkdtemp(prefix="plexus-shared-")
    return _OWN["local"]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already at exit
        pass


def _remove_all(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _remove(spark, path)


_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the process ends."""
    if not _WRITTEN:
        atexit.register(_remove_all, spark, _WRITTEN)
    _WRITTEN.append(f"{root(spark)}/plexus-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialise(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors: the
    table does not live on any of them. The table goes when the process ends.
    rows: where the caller has counted them, a bound on the rows; then there is
    a file for each ROWS_A_FILE of them at most, so that small tables are not
    strewn over as many files as there are partitions.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}"
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_FILE + 1)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows that one task writes quickly.
ROWS_A_FILE = 500_000


def held(df: DataFrame) -> DataFrame:
    """Keep a table of narrow rows on the executors' disks, as it is read several times.

    The lineage stays: what goes with an executor is computed anew. Loops and
    results of long computations are written with ``materialise`` instead. The
    blocks go with ``spark.catalog.clearCache()`` or the session.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table of unknown size in files by its rows: it is held, counted, written and let go."""
    df = held(df)
    out = materialise(df, name, rows=df.count())
    df.unpersist()
    return out


def put_bytes(spark: SparkSession, content: bytes, name: str) -> str:
    """Write a file of the driver's to the shared folder; its path. It goes when the process ends."""
    path = f"{folder(spark)}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(content)
    finally:
        out.close()
    return path


def drop(df: DataFrame) -> None:
    """Delete a materialised table, with its folder, that no later plan reads."""
    for f in {x.rsplit("/", 2)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)
        if f in _WRITTEN:
            _WRITTEN.remove(f)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, so that very long texts do not add up to a huge batch.

    This setting of the session stays, as it is read when a plan runs and not when it is made.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


#: A side of a join is broadcast only if it has been counted and has no more rows than this; beyond it the join shuffles.
SMALL = 200_000


def bounded(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Broadcast a materialised table of a counted, small size (narrow rows); else leave the join to the shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def lean(batches):
    """Pass batches on; afterwards give the worker's free memory back, as it stays for further tasks."""
    yield from batches
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
