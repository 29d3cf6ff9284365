r"""Exact deduplication with a log-structured merge index of digests.

A memtable is the slice of the input that one task holds; a flush writes each as a run sorted by digest, with min-max fences
and a Bloom filter per row group in the file. Compaction merges runs and the previous level into a new level: of each digest
the best identifier (most code points in the original text, then smallest id) and the number of rows. A level counts only
when its manifest, written last, names the runs that it has absorbed; so a flush or compaction that was cut off is redone or
ignored, and nothing is counted twice.

Hits (digests with two rows or more) receive byte verification: the smallest and the largest text of a digest are compared
byte by byte, which map-side combining keeps to one row per digest and task, however large the group. Only texts that a
bit filter over the hits lets through are shuffled for that. Should texts of one digest differ, their rows are grouped by
the texts themselves.

The filter has a fixed size (FILTER_WORDS longs); when hits outgrow it more texts are shuffled, and results stay the same.

Cases: null counts as an empty text, and all empty texts are one group. Rows with equal ids are rows of their own, of which one
stays; a null id loses against any other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import delete, documents, exists, new_path, stored, text_of

FILTER_WORDS = 1 << 17


def normalised(text: str = "text") -> Column:
    return F.translate(text_of(text), " \t\n\x0b\x0c\r", "")


def sha(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _rank() -> Column:
    """Smaller is better. The row's number decides between equal ids."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


class DigestIndex:
    """Runs and levels under `path`. digest_bytes: how much of the SHA-256 is the key (tests shorten it to make collisions)."""

    def __init__(self, spark: SparkSession, path: str, digest_bytes: int = 32):
        self.spark, self.path, self.digest_bytes = spark, path, digest_bytes

    def key(self, digest: Column) -> Column:
        return digest if self.digest_bytes == 32 else F.substring(digest, 1, self.digest_bytes)

    def _names(self, start: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = "manifest" if start == "level-" else "data/_SUCCESS"
        return sorted(x for x in found if x.startswith(start) and exists(self.spark, f"{self.path}/{x}/{done}"))

    def flush(self, rows: DataFrame, run: str) -> DataFrame:
        """Write rows (doc_id, n_chars, sha, and what else there is), numbered, as run `run`, unless it is there already."""
        at = f"{self.path}/run-{run}/data"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            keyed = rows.withColumn("key", self.key(F.col("sha"))).withColumn("row", F.concat(F.lit(f"{run}-"), F.monotonically_increasing_id().cast("string")))
            keyed.sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("compression", "zstd").parquet(at)
        return self.spark.read.parquet(at)

    def _absorbed(self, level: str) -> set[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{level}/manifest")
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(at)
        try:
            return set(json.loads(stream.readUTF()))
        finally:
            stream.close()

    def compact(self) -> DataFrame:
        """The newest level, in which all runs are merged: key, best (rank struct), n. Older levels go; runs stay, since they hold the rows themselves. Without runs the level is empty."""
        levels, runs = self._names("level-"), self._names("run-")
        done = self._absorbed(levels[-1]) if levels else set()
        fresh = [r for r in runs if r not in done]
        if fresh or not levels:
            parts = [self.spark.read.parquet(f"{self.path}/{r}/data").select("key", _rank().alias("best"), F.lit(1).cast("long").alias("n")) for r in fresh]
            parts += [self.level()] if levels else []
            if not parts:
                return self.spark.createDataFrame([], "key binary, best struct<less: int, none: boolean, doc_id: bigint, row: string>, n long")
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            name = f"level-{int(levels[-1][6:]) + 1 if levels else 0:08d}"
            merged = rows.groupBy("key").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            merged.sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("compression", "zstd").parquet(f"{self.path}/{name}/data")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/manifest")
            stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
            stream.writeUTF(json.dumps(sorted(done | set(fresh))))
            stream.close()
            for old in levels:
                delete(self.spark, f"{self.path}/{old}")
        return self.level()

    def level(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._names('level-')[-1]}/data")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """key, best, n of these digests (few: they become a filter of the scan). The fences and Bloom filters of the level's files decide which row groups are read."""
        return self.level().filter(F.col("key").isin([bytearray(d if self.digest_bytes == 32 else d[: self.digest_bytes]) for d in digests]))


def bit_filter(hits: DataFrame, words: int = FILTER_WORDS) -> Column:
    """A scalar array of longs in which two bits stand for each key."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.col("key"), F.lit(s)), F.lit(words * 64)) for s in (1, 2)]))
    bits = hits.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    dense = hits.sparkSession.range(words).withColumnRenamed("id", "word").join(bits, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()


def let_through(filter_: Column, key: Column, words: int = FILTER_WORDS) -> Column:
    ok = F.lit(True)
    for s in (1, 2):
        p = F.pmod(F.xxhash64(key, F.lit(s)), F.lit(words * 64))
        ok = ok & (F.call_function("shiftright", F.get(filter_, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return ok


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept (true for one row of each group), text_sha256: one row per row of docs (doc_id, text)."""
    spark = docs.sparkSession
    index = DigestIndex(spark, new_path(spark, "digests"), digest_bytes)
    texts = docs.select("doc_id", "text").withColumn("norm", normalised())
    kept = F.col("best").isNull() | (F.col("best.row") == F.col("row"))
    run = index.flush(texts.select("doc_id", F.length(text_of("text")).alias("n_chars"), sha(F.col("norm")).alias("sha")), "documents")
    hits = index.compact().filter("n > 1")
    # byte verification
    seen = texts.select(index.key(sha(F.col("norm"))).alias("key"), "doc_id", "text", "norm").filter(let_through(bit_filter(hits), F.col("key")))
    pairs = seen.groupBy("key").agg(F.min("norm").alias("first"), F.max("norm").alias("last"))
    unlike = stored(pairs.filter("first <> last").select("key"), "unlike")
    out = run.join(hits, "key", "left")
    columns = ["doc_id", F.when(F.col("best").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    if not unlike.isEmpty():
        rows = texts.withColumn("key", index.key(sha(F.col("norm")))).join(unlike, "key").withColumn("n_chars", F.length(text_of("text"))).withColumn("sha", sha(F.col("norm")))
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id().cast("string")), "unlike")
        groups = rows.groupBy("norm").agg(F.min(_rank()).alias("best"), F.count("*").alias("n"))
        out = out.join(unlike, "key", "left_anti").select(*columns).unionByName(rows.join(groups, "norm").select(*columns))
    else:
        out = out.select(*columns)
    return out


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the row of its group that stays, the group's size, whether the row stays, and the digest."""
    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
