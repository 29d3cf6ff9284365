"""Tables that jobs share: a folder that the driver and all executors reach, tables written and read again, and a keyed table of computed rows with versions."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a new folder of this machine for a local master, and an error on a cluster."""
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


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    try:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
    except Exception:  # noqa: BLE001  the session has gone, and its folder with it
        pass


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docspark-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def stored(df: DataFrame, name: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """df written as a table in the shared folder, with options of the writer, and read again, as another schema of the same layout if one is given."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer tasks than the cluster has cores, dealt to all cores; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key, before each becomes many: what is exploded from them lies by key already, and windows, groups and joins by key shuffle it no more. A scan's task gives several partitions, since what is sorted there is a multiple of what is read."""
    return df.repartition(max(8 * df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism), key)


class KeyedCache:
    """Computed rows by key: a folder of parts, and a commit file for each part, written when the part is whole. Parts without a commit are not read. A commit names all keys that the cache has up to then, by number and by an order-free digest, so that a full hit needs no join."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _commits(self) -> list[dict]:
        names = [n for n in listed(self.spark, f"{self.path}/commits") if n.endswith(".json")]
        if not names:
            return []
        rows = self.spark.read.schema("version int, part string, keys long, digest decimal(38,0)").json(f"{self.path}/commits/*.json").collect()  # a row a version
        return sorted((r.asDict() for r in rows), key=lambda r: r["version"])

    def rows(self) -> DataFrame:
        parts = [f"{self.path}/parts/{c['part']}" for c in self._commits()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def _named(self, df: DataFrame) -> tuple[int, int]:
        r = df.select(F.xxhash64(self.key).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).first()
        return r.n, int(r.h)

    def get_or_compute(self, base: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The cached rows of base's keys (each once; nulls have none). Only missing rows of base are given to compute, and only if there are any; what it returns, with each key once, becomes a new part. A second writer of the same version fails at the commit."""
        base = base.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        commits = self._commits()
        if commits and self._named(base) == (commits[-1]["keys"], int(commits[-1]["digest"])):
            return self.rows()
        have = self.rows().select(self.key)
        missing = base.join(have, self.key, "left_anti")
        if not missing.isEmpty():
            part = uuid.uuid4().hex
            names = [f.name for f in self.schema.fields]
            compute(missing).select(*names).write.parquet(f"{self.path}/parts/{part}")
            every = have.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/parts/{part}").select(self.key))
            n, h = self._named(every)
            self._commit({"version": len(commits) + 1, "part": part, "keys": n, "digest": h})
        return self.rows().join(base.select(self.key), self.key, "left_semi")

    def _commit(self, entry: dict) -> None:
        fs, at = _fs(self.spark, f"{self.path}/commits/{entry['version']:06d}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()


def ingest(batch: DataFrame, batch_id: int, path: str, key: str = "doc_id", by: tuple[str, ...] = ("split", "class_name"), failures: str | None = None) -> None:
    """One batch into a store of Parquet files by split, class and batch: each key once, the first of its rows by all columns; keys that an earlier batch stored are skipped, rows with an error go to the failures instead. A batch that is played again replaces its own files and nothing else. Null keys are failures."""
    spark = batch.sparkSession
    error = F.coalesce("error", F.when(F.col(key).isNull(), F.lit("no key"))) if "error" in batch.columns else F.when(F.col(key).isNull(), F.lit("no key"))
    rows = batch.withColumn("error", error)
    good = rows.filter("error IS NULL").drop("error")
    good = good.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*good.columns)).alias("r")).select("r.*")
    if exists(spark, path):
        earlier = spark.read.parquet(path).filter(F.col("batch") < batch_id).select(key)
        good = good.join(earlier, key, "left_anti")
    good.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)
    if failures:
        rows.filter("error IS NOT NULL").write.mode("overwrite").json(f"{failures.rstrip('/')}/batch={batch_id}")


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", by: tuple[str, ...] = ("split", "class_name"), failures: str | None = None):
    """Starts `ingest` for every micro-batch of a stream, all that is there now, and returns the running query."""
    return stream.writeStream.foreachBatch(lambda df, n: ingest(df, n, path, key, by, failures)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, without their batch."""
    return spark.read.parquet(path).drop("batch")


def write_split_tables(df: DataFrame, path: str, splits: tuple[str, ...] = ("train", "val", "test")) -> None:
    """CSV folders with a header: all rows, and those of each split."""
    for name in ("all", *splits):
        part = df if name == "all" else df.filter(F.col("split") == name)
        part.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


def write_reports(tables: dict[str, DataFrame], path: str) -> None:
    """Short tables as a CSV folder each, and together as one JSON file of lines named by table (A01 to A05 are of bounded size)."""
    summary = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"))
        summary = rows if summary is None else summary.unionByName(rows)
    if summary is not None:
        summary.groupBy("table").agg(F.sort_array(F.collect_list("row")).alias("rows")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/summary")
