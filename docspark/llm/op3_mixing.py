"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents shuffled, form a stream that is cut into blocks of equal length; where a target exceeds
the source's size the stream starts again. Slot j of the schedule is the point frac(j * golden ratio) on the cumulative
target weights; the rank of a slot among the slots of its source says which block it takes. A schedule of this kind stays
within a few slots of every source's share in each of its prefixes; what rounding leaves out comes at the end, so every
source gives exactly floor(target) words.

Scale: the text is read once for sizes. Running sums over a hot source, or over its slots, go in two levels (sums per range
of the shuffle key or of slots, then a window inside a range), so no task holds a source. The join of slots and blocks is
on (source, block).

Cases: null texts and texts without words have size 0 and nothing of them is taken. A null source is one source, last in
order. Null or repeated ids are rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import WORD, documents, stored, text_of

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: A block has at most this many words; fewer where the mix would have under SLOTS blocks.
BLOCK_WORDS, SLOTS = 1024, 65536
GOLDEN = 0.6180339887498949
#: Slots in a range of the two-level rank; cells of the grid that finds a point's source.
RANGE, CELLS = 256, 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, k (the source as a key that is never null and sorts by code point, null last), size, h (shuffle key)."""
    return docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), "2").otherwise(F.concat(F.lit("1"), "source")).alias("k"),
        F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"),
        # rows without an id are told apart by their text
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text_of("text").cast("binary")))).cast("binary")).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """k, source_size, target: shares of share * all words by weight; a target stops at cap * its source, and what is over goes to the others by weight. With sources in order of cap / weight those that stop come first, and running sums give the level of the rest. One row a source."""
    per = sized.groupBy("k").agg(F.sum("size").alias("source_size"))
    one, up = W.partitionBy(), W.orderBy("ratio", "k").rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy("k")) - 1) % len(weights) + 1)
    per = per.withColumn("w", weight.cast("long")).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    level = (F.sum("source_size").over(one) * F.lit(share) - F.coalesce(F.sum("most").over(up), F.lit(0))) / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(up), F.lit(0)))
    per = per.withColumn("level", level).withColumn("stops", F.col("ratio") <= F.col("level"))
    rest = F.max(F.when(~F.col("stops"), F.col("level"))).over(one)
    return per.select("k", "source_size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("w") * rest).alias("target"))


def block_words(total: int, most: int = BLOCK_WORDS, slots: int = SLOTS) -> int:
    return max(1, min(most, total // slots))


def schedule(per_source: DataFrame, block: int, total_slots: int) -> DataFrame:
    """slot, k, block: the order in which blocks are taken. Every block of floor(target) words occurs once."""
    spark = per_source.sparkSession
    needed = per_source.select("k", F.ceil(F.floor("target") / block).cast("long").alias("needed"))
    share = F.col("needed") / F.sum("needed").over(W.partitionBy())
    hi = F.sum("needed").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) / F.sum("needed").over(W.partitionBy())
    spans = needed.filter("needed > 0").withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("k")), F.lit(0.0))).withColumn("share", share)
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    slots = spark.range(total_slots).withColumnRenamed("id", "slot").withColumn("x", point).withColumn("cell", F.floor(F.col("x") * CELLS))
    slots = slots.join(spans, "cell").filter("x >= lo AND x < hi").select("slot", "k", "needed", F.floor(F.col("slot") / RANGE).alias("range"))
    counts = slots.groupBy("k", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranks = slots.join(counts.select("k", "range", F.coalesce(before, F.lit(0)).alias("before")), ["k", "range"])
    ranks = ranks.withColumn("block", F.col("before") + F.row_number().over(W.partitionBy("k", "range").orderBy("slot")) - 1)
    had = counts.groupBy("k").agg(F.sum("n").alias("had"))
    late = needed.join(had, "k", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < needed")
    late = late.select("k", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("block"))
    return ranks.filter("block < needed").select("slot", "k", "block").unionByName(late.select(F.lit(total_slots).cast("long").alias("slot"), "k", "block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_most: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: doc_id, source, k, size, source_size, target, start (of the document in its source's stream).
    Pieces, in the order of slot: slot, k, block, doc_id, start, pass (0: the first time through the source), offset and length in words of the document's part that the block takes."""
    sized = stored(sizes(docs), "sizes")
    per = stored(targets(sized, weights, share, cap), "targets")
    words, = per.select(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()
    block = block_words(words, block_most)
    total_slots = -(-words // block)
    w = W.partitionBy("k", "part").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    parted = sized.withColumn("part", F.substring("h", 1, 3))
    parts = parted.groupBy("k", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("k", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = parted.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0))).join(parts, ["k", "part"]).join(per, "k")
    placed = placed.select("doc_id", "source", "k", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("start"))
    placed = stored(placed, "placed")
    end = F.floor("target")
    pieces = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-cap // 1) - 1)))))
    pieces = pieces.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), end)).filter("lo < hi")
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    a, b = F.greatest("lo", F.col("block") * block), F.least("hi", (F.col("block") + 1) * block)
    pieces = pieces.select("k", "block", "doc_id", "start", "size", "pass", (a - F.col("lo")).alias("offset"), (b - a).alias("length"))
    return placed, pieces.join(schedule(per, block, total_slots), ["k", "block"]).select("slot", "k", "block", "doc_id", "start", "size", "pass", "offset", "length")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, the words that the mix takes of it, and the first and last slots of the schedule that take some (null: none)."""
    placed, pieces = mix(documents(spark, sf_dir))
    taken = pieces.groupBy("k", "start").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    # a start is one document's in its source, among those with words
    full = placed.filter("size > 0").join(taken, ["k", "start"], "left")
    none = placed.filter("size = 0").withColumns({c: F.lit(None).cast("long") for c in ("taken", "first_slot", "last_slot")})
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_slot", "last_slot")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
r AS (SELECT k, source_size, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, source_size * 2 AS most, CAST(source_size * 2 AS DOUBLE) / w AS ratio FROM r),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(most) OVER up, 0) AS DOUBLE))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS DOUBLE) AS level
  FROM c WINDOW up AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT k, source_size, CASE WHEN ratio <= level THEN CAST(most AS DOUBLE)
         ELSE w * max(CASE WHEN ratio > level THEN level END) OVER () END AS target
  FROM l),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d),
n AS (SELECT k, CAST(ceil(floor(target) / b.block) AS BIGINT) AS needed, CAST(floor(target) AS BIGINT) AS words, b.block, b.slots FROM t,
      (SELECT block, CAST((words + block - 1) // block AS BIGINT) AS slots FROM (SELECT words, greatest(1, least(1024, words // 65536)) AS block FROM (SELECT CAST(sum(floor(target)) AS BIGINT) AS words FROM t))) b),
spans AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY k), 0.0) AS lo FROM (
  SELECT *, CAST(sum(needed) OVER (ORDER BY k) AS DOUBLE) / CAST(sum(needed) OVER () AS DOUBLE) AS hi FROM n WHERE needed > 0)),
points AS (SELECT slot, slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS x FROM (SELECT unnest(range((SELECT max(slots) FROM n))) AS slot)),
ranked AS (SELECT slot, k, needed, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS block FROM points JOIN spans ON x >= lo AND x < hi),
late AS (SELECT n.slots AS slot, n.k, unnest(range(CAST(coalesce(h.had, 0) AS BIGINT), n.needed)) AS block FROM n LEFT JOIN (SELECT k, count(*) AS had FROM ranked GROUP BY k) h USING (k)),
schedule AS (SELECT slot, k, block FROM ranked WHERE block < needed UNION ALL SELECT slot, k, block FROM late),
pieces AS (
  SELECT doc_id, k, start, size, lo, hi, bl, unnest(range(CAST(lo // bl AS BIGINT), CAST((hi - 1) // bl + 1 AS BIGINT))) AS block FROM (
    SELECT p.doc_id, p.k, p.start, p.size, pass * source_size + p.start AS lo, least(pass * source_size + p.start + p.size, n.words) AS hi, n.block AS bl
    FROM p JOIN t USING (k) JOIN n USING (k), (VALUES (0), (1)) v(pass) WHERE p.size > 0) WHERE lo < hi),
took AS (
  SELECT k, start, sum(least(hi, (pieces.block + 1) * bl) - greatest(lo, pieces.block * bl)) AS taken, min(slot) AS first_slot, max(slot) AS last_slot
  FROM pieces JOIN schedule USING (k, block) GROUP BY k, start)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken, source,
       CASE WHEN size > 0 THEN first_slot END AS first_slot, CASE WHEN size > 0 THEN last_slot END AS last_slot
FROM p JOIN t USING (k) LEFT JOIN took USING (k, start)
"""
