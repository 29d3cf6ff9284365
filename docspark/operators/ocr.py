"""OCR output: raw word rows to ordered words, lines, blocks, full text and statistics. Everything is grouped per document, so one shuffle by document serves the words and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import spaced

LINE = ["page_num", "block_num", "par_num", "line_num"]


def prepare_words(raw: DataFrame, width: Column, height: Column, min_confidence: float = 0.0) -> DataFrame:
    """Numbers are coerced (null where they are none), blank texts and low confidence go, edges and shares of the page are added, null group numbers are 0, and word_id is the place in reading order."""
    number = lambda c, kind: F.expr(f"try_cast({c} AS {kind})")
    df = raw.withColumns({c: number(c, "double") for c in ("conf", "left", "top", "width", "height")} | {c: F.coalesce(number(c, "int"), F.lit(0)) for c in [*LINE, "word_num"]})
    df = df.withColumn("text", spaced(F.col("text"))).filter((F.col("text") != "") & (F.coalesce("conf", F.lit(-1.0)) >= min_confidence))
    df = df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("left", "top", "width", "height")})
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    df = df.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height"), "norm_left": F.col("left") / w, "norm_top": F.col("top") / h, "norm_width": F.col("width") / w, "norm_height": F.col("height") / h})
    order = W.partitionBy("doc_id").orderBy(*LINE, "left", "top", "word_num")
    return df.withColumn("word_id", F.row_number().over(order) - 1)


def _box() -> list[Column]:
    left, top, right, bottom = F.min("left"), F.min("top"), F.max("right"), F.max("bottom")
    return [left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"), right.alias("right"), bottom.alias("bottom")]


def lines(words: DataFrame) -> DataFrame:
    """Words of a line joined by blanks from left to right; line_id counts lines of a document in order."""
    ordered = F.array_sort(F.collect_list(F.struct("left", "top", "word_id", "text")))
    df = words.groupBy("doc_id", *LINE).agg(*_box(), ordered.alias("_w"))
    df = df.withColumn("text", F.trim(F.array_join(F.transform("_w", lambda x: x["text"]), " "))).withColumn("word_ids", F.transform("_w", lambda x: x["word_id"]))
    return df.withColumn("line_id", F.row_number().over(W.partitionBy("doc_id").orderBy(*LINE)) - 1).drop("_w")


def blocks(lines_: DataFrame) -> DataFrame:
    """Lines of a block that have text, from top to bottom."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("top", "left", "line_id", "text"))))
    df = lines_.groupBy("doc_id", "page_num", "block_num").agg(*_box(), ordered.alias("_l"))
    df = df.withColumn("text", F.trim(F.array_join(F.transform("_l", lambda x: x["text"]), "\n")))
    return df.withColumn("block_id", F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "block_num")) - 1).drop("_l")


def full_text(lines_: DataFrame) -> DataFrame:
    order = F.struct(*LINE, "top", "left", "text")
    return lines_.groupBy("doc_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "\n")).alias("full_text"))


def stats(raw: DataFrame, words: DataFrame, lines_: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Counts, mean confidence and the share of raw rows with text; zeros for documents that have none."""
    rows = raw.groupBy("doc_id").agg(F.avg((F.trim(F.coalesce("text", F.lit(""))) != "").cast("int")).alias("nonempty_word_ratio"))
    w = words.groupBy("doc_id").agg(F.count("*").alias("num_words"), F.avg("conf").alias("avg_word_conf"))
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    df = rows.join(w, "doc_id", "left").join(n(lines_, "num_lines"), "doc_id", "left").join(n(blocks_, "num_blocks"), "doc_id", "left").na.fill(0)
    return df.withColumn("ocr_quality_score", quality_score(F.col("avg_word_conf"), F.col("nonempty_word_ratio"), F.col("num_words")))


def quality_score(conf: Column, ratio: Column, n: Column) -> Column:
    cut = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return 0.55 * cut(conf / 100) + 0.25 * cut(ratio) + 0.20 * cut(F.log1p(n) / F.log(F.lit(201.0)))


def context(words: DataFrame, before: int, after: int, partition: str = "doc_id", order: str = "word_id") -> DataFrame:
    """words with column context: the words from `before` places ahead up to `after` places on, joined by blanks."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(-before, after)
    return words.withColumn("context", F.array_join(F.collect_list("text").over(w), " "))


def batch_status(metadata: DataFrame, words: DataFrame, processed: DataFrame, cache: DataFrame) -> DataFrame:
    """A row for each document of metadata (doc_id, file_path or source_path, perhaps split and class_name): status, error, num_words, avg_conf, cache_hit. What is in cache (doc_id, num_words, avg_conf) is not counted again;
    other documents are ok if processed (doc_id) has them, also without words, and failed with zeros otherwise: a failure is a row and stops nothing. Each of the tables but words has one row for a document."""
    path = next((c for c in ("file_path", "source_path") if c in metadata.columns), None)
    if "doc_id" not in metadata.columns or path is None:
        raise ValueError("metadata must have doc_id, and file_path or source_path")
    extra = [F.col(c) if c in metadata.columns else F.lit(None).cast("string").alias(c) for c in ("split", "class_name")]
    base = metadata.select("doc_id", F.col(path).alias("file_path"), *extra)
    hit = cache.select("doc_id", F.col("num_words").alias("_n"), F.col("avg_conf").alias("_c"), F.lit(True).alias("_hit"))
    counted = words.join(cache, "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("_words"), F.avg("conf").alias("_conf"))
    df = base.join(hit, "doc_id", "left").join(processed.select("doc_id", F.lit(True).alias("_done")), "doc_id", "left").join(counted, "doc_id", "left")
    ok, n, conf = F.col("_hit").isNotNull() | F.col("_done").isNotNull(), F.coalesce("_n", "_words", F.lit(0)), F.coalesce("_c", "_conf", F.lit(0.0))
    return df.select(
        *base.columns,
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok, "no OCR output").alias("error"),
        F.when(ok, n).otherwise(0).alias("num_words"),
        F.when(ok, conf).otherwise(0.0).alias("avg_conf"),
        F.col("_hit").isNotNull().alias("cache_hit"),
    )
