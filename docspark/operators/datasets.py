"""Data sets of classified files: official or new splits, required classes, summaries, coverage of texts, pooled vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.numeric import unit_vector
from docspark.operators.catalog import stratified_split

SPLITS = ("train", "val", "test")


def official_or_new_split(df: DataFrame, official: str, stratum: str, key: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: str = "42") -> DataFrame:
    """df with column split. Official train, val and test are taken as they are (rows without one stay null); with train and test only, val is carved from train by stratum; any other layout, unknown names among it, gives a new split of all rows."""
    if abs(train + val + test - 1) > 1e-8:
        raise ValueError("shares must sum to 1")
    o = F.col(official)
    seen = df.agg(*[F.coalesce(F.bool_or(o == s), F.lit(False)).alias(s) for s in SPLITS], F.coalesce(F.bool_or(o.isNotNull() & ~o.isin(*SPLITS)), F.lit(False)).alias("other")).first()  # one row
    if all(seen[s] for s in SPLITS) and not seen.other:
        return df.withColumn("split", o)
    if seen.train and seen.test and not seen.other:
        carved = stratified_split(df.filter(o == "train"), stratum, key, {"train": train / (train + val), "val": val / (train + val)}, seed)
        return carved.unionByName(df.filter(F.coalesce(o != "train", F.lit(True))).withColumn("split", F.when(o == "test", "test")))
    return stratified_split(df, stratum, key, {"train": train, "val": val, "test": test}, seed)


def require_classes(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Rows of these classes; an error that names the classes of which there is none."""
    chosen = df.filter(F.col(column).isin(*classes))
    found = set(chosen.agg(F.collect_set(column).alias("c")).first().c)  # at most the classes asked for
    if missing := [c for c in classes if c not in found]:
        raise ValueError(f"no rows of {', '.join(missing)}")
    return chosen


def dataset_summary(df: DataFrame, selected: Column, split: str = "split", label: str = "class_name", keys: Sequence[str] = ()) -> DataFrame:
    """part, name, n: all rows, selected ones, the selected by split and by class; and rows of groups of two or more by each of `keys` (null when no selected row has the key, as when files were not hashed)."""
    s = F.coalesce(selected, F.lit(False))
    row = lambda part, name, on: F.when(on, F.struct(F.lit(part).alias("part"), name.alias("name")))
    none = F.lit(None).cast("string")
    marks = F.array_compact(F.array(row("all", none, F.lit(True)), row("selected", none, s), row("split", F.col(split), s & F.col(split).isNotNull()), row("class", F.col(label), s & F.col(label).isNotNull())))
    out = df.select(F.explode(marks).alias("m")).groupBy("m").agg(F.count("*").alias("n")).select("m.part", "m.name", "n")
    for k in keys:
        per = df.filter(s & F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n"))
        out = out.unionByName(per.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n")).select(F.lit("duplicates").alias("part"), F.lit(k).alias("name"), "n"))
    return out


def text_coverage(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, n, empty, empty_percent, mean_chars, mean_words (two decimals); null and blank texts are empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    empty, words = ~t.rlike(r"\S"), F.regexp_count(t, F.lit(r"\S+"))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.round(100 * F.avg(empty.cast("int")), 2).alias("empty_percent"), F.round(F.avg(F.length(t)), 2).alias("mean_chars"), F.round(F.avg(words), 2).alias("mean_words"))


def mean_vectors(df: DataFrame, by: str, vector: str, weight: str) -> DataFrame:
    """by, vector: the mean of the vectors by weight (a mask of 0 and 1, or any weight), divided by its length. Sums are kept by place, so a large group is combined before the shuffle."""
    e = df.select(by, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    sums = e.groupBy(by, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias("_m"))
    rows = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))  # one entry a place of the vector
    return rows.select(by, unit_vector(F.transform("_v", lambda v: v["_m"])).alias(vector))
