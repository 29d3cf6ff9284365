"""Catalogue of files: classes and splits from paths, contingency tables, duplicates, deterministic splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import slug

# What folder names stand for.
CLASS_ALIASES = {
    "invoice": ["invoice", "invoices"],
    "form": ["form", "forms"],
    "resume": ["resume", "resumes", "cv", "curriculum_vitae"],
    "email": ["email", "emails", "e-mail", "mail"],
    "budget": ["budget", "budgets"],
}
SPLIT_ALIASES = {"train": ["train", "training"], "val": ["val", "valid", "validation", "dev"], "test": ["test", "testing"]}


def infer_from_path(path: Column, aliases: dict[str, list[str]]) -> Column:
    """The first name, in the order of the aliases, of which an alias equals a part of the path; null if none."""
    parts = F.transform(F.split(path, "/"), slug)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in aliases.items():
        normal = sorted({w.replace("-", "_") for w in words})
        out = out.when(F.arrays_overlap(parts, F.array(*map(F.lit, normal))), name)
    return out


def label_in_path(path: Column, labels: Sequence[str]) -> Column:
    """The first label that occurs anywhere in the lower-cased path."""
    return F.coalesce(*[F.when(F.lower(path).contains(x), x) for x in labels])


def range_part(df: DataFrame, column: str, side: int = 16) -> Column:
    """Number of the range that a string falls into; ranges are in order, and bounded by the side * side values of least hash. They only deal out the work: equal values share a range, and what is exact stays exact whatever the bounds. One job finds them, as for any sort; a row is compared with side bounds twice."""
    drawn = df.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(side * side).collect()
    bounds = sorted({r[0] for r in drawn})
    if not bounds:
        return F.lit(0)
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    reached = lambda among: F.coalesce(F.size(F.filter(among, lambda b: b <= F.col(column))), F.lit(0))
    literal = lambda values: F.array(*map(F.lit, values))
    block = reached(literal([b[0] for b in blocks]))
    return block * (side + 1) + F.greatest(F.lit(0), reached(F.get(F.array(*map(literal, blocks)), block - 1)))


def metadata(files: DataFrame) -> DataFrame:
    """files (path, length, maybe content): doc_id by order of the path, class, split, extension, digest of the content if it was read."""
    path = F.col("path")
    df = files.withColumns({
        "class_name": infer_from_path(path, CLASS_ALIASES),
        "split_original": infer_from_path(path, SPLIT_ALIASES),
        "file_ext": F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)),
    })
    if "content" in files.columns:
        df = df.withColumn("hash_md5", F.md5("content")).drop("content")
    # the rank of a path in two levels: by ranges of paths, then inside
    part = range_part(df, "path")
    sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("path")) - 1
    return df.withColumn("_part", part).join(before, "_part").withColumn("doc_id", F.format_string("doc_%08d", place)).drop("_part", "_before")


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """All members of groups of two or more, with the group's size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return df.join(sizes, key)


def summary(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, keys with duplicates, rows in excess."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("excess"))


def stratified_split(df: DataFrame, stratum: str, key: str, shares: dict[str, float], seed: str = "42") -> DataFrame:
    """df with column split: in each stratum the first share of rows, in the order of a digest of seed and key, and so on. Shares sum to 1."""
    if abs(sum(shares.values()) - 1) > 1e-8:
        raise ValueError("shares must sum to 1")
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    # ranks in two levels, by the digest's first characters and inside: no task holds a stratum
    df = df.withColumn("_order", order).withColumn("_part", F.substring("_order", 1, 3)).withColumn("_stratum", F.struct(F.col(stratum).alias("s")))
    sizes = df.groupBy("_stratum", "_part").agg(F.count("*").alias("_n"))
    own = W.partitionBy("_stratum")
    sizes = sizes.select("_stratum", "_part", F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_all"))
    df = df.join(sizes, ["_stratum", "_part"])
    place = (F.col("_before") + F.row_number().over(W.partitionBy("_stratum", "_part").orderBy("_order", key)) - 1) / F.col("_all")
    out, edge = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        edge = sum(list(shares.values())[: list(shares).index(name) + 1])
        out = F.when(F.col("_place") < edge, name).otherwise(out)
    return df.withColumn("_place", place).withColumn("split", out).drop("_place", "_order", "_part", "_stratum", "_before", "_all")


def sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows in the order of a digest of seed and key: the same rows in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def replace_class(df: DataFrame, other: DataFrame, column: str, value: str) -> DataFrame:
    """df with the rows of one class replaced by another table's."""
    return df.filter(F.col(column) != value).unionByName(other, allowMissingColumns=True)


def coverage(base: DataFrame, ready: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of base that are ready, and those that are missing."""
    return base.join(ready.select(key).distinct(), key, "left_semi"), base.join(ready.select(key), key, "left_anti")


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; the combiner keeps one row of a key in each task, so a large group is no large task. Rows with null keys are a group."""
    return df.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(key)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")
