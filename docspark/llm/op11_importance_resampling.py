r"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their word runs than the corpus does.

A text is scanned once by a ring of running CRC-32 states, one for each of the last n starts. A word extends every state by a
space and its bytes and opens a state of its own; each state then is the CRC-32 of a run of 1 to n words that ends here, and
its remainder the run's bucket. Texts come in pieces: a word that a piece cuts keeps its states open, so that memory is that
of a piece and of the buckets. The buckets of each document are stored, two bytes or so a word; the corpus is counted from
them by a grouping with partial sums, and the weights are summed from them with a table of `buckets` gains, whose size is a
parameter and not the data's. Texts are read once, and never shuffled.

Scores are weights plus Gumbel noise that a digest of the id gives, so that the highest scores are a weighted sample without
replacement and reruns agree. Ranks are places in one range-partitioned sort of a few numbers a row, each partition's offset
being the sum of the sizes before it; no task holds more than a range of it.

Cases: null and empty texts and texts without words have no features, weight 0 and no rank. A null id is digested as an empty
string and ranks behind equal scores. Repeated rows are rows of their own; rows of equal score and id are ordered by weight
and number of features, which makes the order of what still ties immaterial. Without target texts, or without documents, all
formulas hold with sums of 0. Further columns stay out of the result, whatever their names; `op11_...` reads id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, stored, text_of

RUN, BUCKETS, SEED, PERCENT, LEAST = 1, 10_000, 2024, 10, 20
PIECE = 1 << 20
#: Bytes of words: ASCII digits and letters, the latter lowered, and all bytes of other characters; the rest become spaces.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
SPACE = 0x20


class CrcRing:
    """CRC-32 of every run of 1 to n words of a text that arrives in pieces of bytes."""

    def __init__(self, n: int):
        self.n, self.states, self.open = n, [], False

    def _start(self, word: bytes) -> None:
        last = self.states[1:] if len(self.states) == self.n else self.states
        more = b" " + word
        self.states = [crc32(more, s) for s in last]
        self.states.append(crc32(word))

    def _words(self, words: list[bytes]) -> list[int]:
        if self.n == 1:  # the ring is the word's own state
            return list(map(crc32, words))
        out: list[int] = []
        for w in words:
            self._start(w)
            out += self.states
        return out

    def feed(self, piece: bytes) -> list[int]:
        """The values of runs that end in this piece."""
        folded = piece.translate(FOLD)
        words, out = folded.split(), []
        if self.open and folded:
            if folded[0] != SPACE:
                head = words.pop(0)
                self.states = [crc32(head, s) for s in self.states]
                if not words and folded[-1] != SPACE:
                    return out
            out += self.finish()
        last = words.pop() if words and folded[-1] != SPACE else None
        out += self._words(words)
        if last is not None:
            self._start(last)
            self.open = True
        return out

    def finish(self) -> list[int]:
        """The values of runs that end with the word that is open."""
        out = list(self.states) if self.open else []
        self.open = False
        return out


def run_buckets(text: bytes, n: int, buckets: int, piece: int = PIECE) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to n words."""
    ring, parts = CrcRing(n), []
    for at in range(0, len(text), piece):
        parts.append(np.array(ring.feed(text[at : at + piece]), np.int64))
    parts.append(np.array(ring.finish(), np.int64))
    found = (np.concatenate(parts) % buckets).astype(np.int32)
    return words_in(len(found), n), found


def words_in(features: int, n: int) -> int:
    """Words that have so many runs of 1 to n words: the first n - 1 words end fewer than n of them."""
    words = 0
    while words < n - 1 and features > 0:
        words += 1
        features -= words
    return words + features // n


def features_of(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, buckets array<int>: one scan of each whole text."""
    rows = df.select(F.col(id).alias("doc_id"), text_of(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [run_buckets(t.as_py(), n, buckets) for t in batch.column(1)]
            sizes = [len(b) for _, b in found]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *[b for _, b in found]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "n_words", "n_features", "buckets"])

    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_features long, buckets array<int>")


def counts_of(features: DataFrame, name: str) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, s, t, gain of every bucket, from the features of both sides."""
    spark = corpus.sparkSession
    both = counts_of(corpus, "s").withColumn("t", F.lit(0)).unionByName(counts_of(target, "t").withColumn("s", F.lit(0)))
    all_ = both.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t")))
    each = all_.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = each.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return each.join(F.broadcast(total)).select("bucket", "s", "t", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # total is one row


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    kind = features.schema["doc_id"].dataType.simpleString()
    sent = features.sparkSession.sparkContext.broadcast(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(sent.value[lists.flatten().to_numpy(zero_copy_only=False)])]).astype(np.int64)
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends[at[1:]] - ends[at[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(add, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 8 hex digits of a SHA-256."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored with `rank`: 1, 2, 3... for the highest scores of documents with `least` words or more, `percent` of a hundred of them, null for the others."""
    fit = F.col("n_words") >= least
    rows = scored.orderBy(fit.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = [(r.part, r.n, r.fit) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(fit).alias("fit")).orderBy("part").collect()]  # a row a partition
    before, starts = 0, []
    for p, n, _ in sizes:
        starts.append((p, before))
        before += n
    draw = sum(f for *_, f in sizes) * percent // 100
    offsets = rows.sparkSession.createDataFrame(starts, "part long, before long")
    place = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = rows.withColumn("part", part).join(F.broadcast(offsets), "part", "left")
    return out.withColumn("rank", F.when(place <= draw, place)).drop("part", "before", "place")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id, text); target has column text."""
    corpus = stored(features_of(docs, n=n, buckets=buckets), "features")
    wanted = features_of(target.select(F.lit(0).alias("doc_id"), "text"), n=n, buckets=buckets)
    table = np.zeros(buckets, np.int64)
    for r in gains(corpus, wanted, buckets).collect():  # as many rows as buckets
        table[r.bucket] = r.gain
    scored = weights(corpus, table).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent, least)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight and score towards `benchmark`, and the ranks of a tenth."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_resample(documents(spark, sf_dir).select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte, over the distinct words; its table comes from the polynomial of the standard.
SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
), words AS (
  SELECT doc_id, true AS own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT NULL, false, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), tally AS (SELECT doc_id, own, word, count(*) AS n FROM words GROUP BY ALL),
octets AS (
  SELECT word, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT word, hex(word) AS h FROM tally)
), bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM octets, tab
), counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM tally JOIN bucketed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS g FROM counted
), weighed AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM tally JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE own GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""
