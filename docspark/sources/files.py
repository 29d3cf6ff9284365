"""Sources and sinks: image files, tables, caches, annotations; all through Spark's readers and writers, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = "*.{png,jpg,jpeg,tif,tiff,bmp,gif,webp}"
# Fixed schema of a cached OCR document.
_BOX = "left int, top int, width int, height int, right int, bottom int, page_num int, block_num int"
OCR = f"doc_id string, source_path string, image_width int, image_height int, full_text string, words array<struct<word_id int, text string, conf double, {_BOX}, par_num int, line_num int>>, lines array<struct<line_id int, text string, {_BOX}, par_num int, line_num int, word_ids array<int>>>, blocks array<struct<block_id int, text string, {_BOX}>>"


def image_files(spark: SparkSession, root: str, content: bool = False, most: int | None = None) -> DataFrame:
    """path and length of image files below root, in the order of paths; the content is read only if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGES).load(root)
    df = df.select("path", "length", *["content"] * content).orderBy("path")
    return df.limit(most) if most is not None else df


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of the OCR cache; broken ones have nulls."""
    return spark.read.schema(OCR).option("mode", "PERMISSIVE").json(path)


def ocr_parts(cache: DataFrame, part: str) -> DataFrame:
    """words, lines or blocks of a cache as rows."""
    return cache.select("doc_id", F.explode(part).alias("x")).select("doc_id", "x.*")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """stem and fields (key to text) of region annotations, one JSON object a file; the stem is the file's name without ending and split suffix."""
    df = spark.read.option("wholetext", True).text(path).select(F.col("value"), F.input_file_name().alias("file"))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.json$", ""), "_hugg_(train|dev|test)$", "")
    return df.select(stem.alias("stem"), F.from_json("value", "map<string,struct<text:string>>").alias("m")).select("stem", F.transform_values("m", lambda k, v: v["text"]).alias("fields"))


def write_splits(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*(by or ("split",))).parquet(path)


def append_failures(df: DataFrame, path: str) -> None:
    """Rows with an error, appended as JSON lines."""
    df.filter(F.col("error").isNotNull()).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def missing_from_cache(base: DataFrame, cache: DataFrame, key: str = "doc_id") -> DataFrame:
    return base.join(cache.select(key), key, "left_anti")


def is_native_pdf(pages: str = "pages", least: int = 100) -> Column:
    """Whether the texts of an array of pages have `least` signs together."""
    return F.aggregate(F.transform(pages, lambda p: F.length(F.coalesce(p, F.lit("")))), F.lit(0), lambda a, n: a + n) >= least


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines, null fields kept; `append` adds files to what is there."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines in a given schema, so no pass infers one; a broken line is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """What write_splits wrote; of one split only its folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)
