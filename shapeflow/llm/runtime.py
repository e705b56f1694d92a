"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple] = []
_watched: list = []
_private: list[str] = []
#: Shuffle files are deleted when the query that wrote them ends, not when the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a private one only where it is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _private:
            _private.append(tempfile.mkdtemp(prefix="shapeflow-"))
            atexit.register(shutil.rmtree, _private[0], True)
        found = "file://" + _private[0]
    return found.rstrip("/")


def _place(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; the folder goes with :func:`release`, with the session, or at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not any(sc is x for x in _watched):
        stop = sc.stop
        sc.stop = lambda: (release(), stop())[1]
        _watched[:] = [sc]
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((p.getFileSystem(sc._jsc.hadoopConfiguration()), p))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back. The table goes with :func:`release`, with the session, or at exit."""
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As :func:`save`, for the rows of all parts, one after another: what a part has shuffled is deleted before the next one begins."""
    path = schema = None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or _place(spark, name), df.schema
        before = spark.conf.get(_FREE)
        spark.conf.set(_FREE, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.set(_FREE, before)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Deletes all tables that :func:`save` has written; results that still read them have to be written before."""
    while _made:
        fs, p = _made.pop()
        fs.delete(p, True)


@atexit.register
def _clean() -> None:
    try:
        release()
    except Exception:  # the JVM may have ended before
        return


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound the rows and bytes of an Arrow batch, so that a Python worker holds few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def remainder(id_col, n: int):
    """crc32(id as text) mod n, the rule by which rows are held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
