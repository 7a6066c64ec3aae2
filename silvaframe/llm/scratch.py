"""Intermediate tables in the folder that the cluster shares.

A written table cuts lineage and survives lost executors: a task that is run
again reads the table, never a block that lived on one executor.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_FOLDERS: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a cluster
    raises ``ValueError``, since its machines share no temporary folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = [tempfile.mkdtemp(prefix="silvaframe-")]
        atexit.register(_remove_local, _FOLDERS[key][0])
    return _FOLDERS[key][0]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Rows and bytes of an Arrow batch of texts; both sides of a Python task hold one whole.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has sizes of its own."""
    for key, size in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    What came before is no longer needed then: the driver collects its garbage,
    so that Spark drops the shuffle files and broadcasts of the lineage that was
    cut, on all machines. The table goes with ``clear``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _FOLDERS.setdefault("written", []).append(path)
    _of(spark, path)[0].deleteOnExit(_of(spark, path)[1])
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _of(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written, and its rows, counted on the way."""
    seen = Observation()
    return written(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def mark() -> int:
    """How many tables ``written`` has left so far; tables before a mark stay if ``clear`` is given it."""
    return len(_FOLDERS.get("written", []))


def clear(spark: SparkSession, keep: tuple[DataFrame, ...] = (), since: int = 0) -> None:
    """Delete every table that ``written`` left after the mark ``since``, but for those that ``keep`` reads; call it once results are stored."""
    read = [f for df in keep for f in df.inputFiles()]
    tables = _FOLDERS.get("written", [])
    for path in tables[since:]:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in read):
            files, where = _of(spark, path)
            files.delete(where, True)
            tables.remove(path)
