"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts give it: a word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """array<string> of the words of a text that is not null; no empty entries."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset a folder of our own serves on one machine (a local master); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="docspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has gone, and its folder with it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docspark-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Paths stored within the innermost stored_alone.
_WITHIN: ContextVar[list[str] | None] = ContextVar("within", default=None)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if (within := _WITHIN.get()) is not None:
        within.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of make. Tables that are stored on the way are deleted: nothing but the result may be read afterwards."""
    outer, made = _WITHIN.get(), []
    token = _WITHIN.set(made)
    try:
        out = stored(make(), name)
    finally:
        _WITHIN.reset(token)
    *passing, own = made
    if outer is not None:
        outer.append(own)
    for path in passing:
        delete(spark, path)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more; it notices when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
