"""Tokens in order: BIO tags and their spans, alignment of sub-words, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_GAP = 15


def bio_from_flat(tokens: DataFrame, field: str = "field") -> DataFrame:
    """tokens (doc_id, pos, field or null) with column tag: B at the start of a run of one field, I inside, O without."""
    before = F.lag(field).over(W.partitionBy("doc_id").orderBy("pos"))
    f = F.col(field)
    return tokens.withColumn("tag", F.when(f.isNull(), "O").when(f.eqNullSafe(before), F.concat(F.lit("I-"), f)).otherwise(F.concat(F.lit("B-"), f)))


def spans(tokens: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, start, end, field, text, conf (mean, four decimals): runs of tags (doc_id, pos, word, tag, conf). A B starts a span; an I goes on with the span of its field, and starts one where there is none unless strict, which drops it."""
    doc = W.partitionBy("doc_id").orderBy("pos")
    f = F.when(F.col("tag") != "O", F.substring("tag", 3, 1 << 20))
    df = tokens.withColumn("_f", f).withColumn("_b", F.col("tag").startswith("B-"))
    starts = F.col("_f").isNotNull() & (F.col("_b") | ~F.col("_f").eqNullSafe(F.lag("_f").over(doc)))
    df = df.withColumn("_new", starts).withColumn("_span", F.sum(F.col("_new").cast("int")).over(doc)).filter("_f IS NOT NULL")
    words = F.array_sort(F.collect_list(F.struct("pos", "word")))
    out = df.groupBy("doc_id", "_span", F.col("_f").alias("field")).agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"), F.round(F.avg("conf"), 4).alias("conf"), F.min_by("_b", "pos").alias("_b")
    )
    return (out.filter("_b") if strict else out).drop("_span", "_b")


def fields(spans_: DataFrame) -> DataFrame:
    """doc_id, field, text: the last span of a field wins."""
    return spans_.groupBy("doc_id", "field").agg(F.max_by("text", "start").alias("text"))


def decoded_fields(tokens: DataFrame) -> DataFrame:
    """doc_id, field, text, conf of tags (doc_id, pos, word, tag, conf), read leniently. B starts a span; I goes on with the span of its field, or starts one if another field's is open. With no span open, an I is appended to what its field has from earlier spans, and starts a span if it has nothing. Of several spans of a field the last stands, with what was appended to it; conf is the mean over all words of the field, those of earlier spans too. Spans of blank words only count for nothing."""
    doc, field = W.partitionBy("doc_id").orderBy("pos"), F.when(F.col("tag") != "O", F.substring("tag", 3, 1 << 20))
    full = F.trim(F.coalesce("word", F.lit(""))) != ""
    df = tokens.withColumn("_f", field).withColumn("_o", F.sum((F.col("tag") == "O").cast("int")).over(doc))
    segment = W.partitionBy("doc_id", "_o").orderBy("pos")
    df = df.withColumn("_first", F.min(F.when(full, F.col("pos"))).over(W.partitionBy("doc_id", "_f"))).withColumn("_start", F.min("pos").over(W.partitionBy("doc_id", "_o")))
    loose = F.col("tag").startswith("I-") & F.coalesce(F.col("_first") < F.col("_start"), F.lit(False))
    # a segment starts with its O, which is no word of it: what is loose from its first word on is appended
    df = df.withColumn("_loose", F.sum(F.when(loose | (F.col("tag") == "O"), 0).otherwise(1)).over(segment) == 0).filter("_f IS NOT NULL")
    rest = W.partitionBy("doc_id", "_o", "_loose").orderBy("pos")
    new = F.col("tag").startswith("B-") | ~F.col("_f").eqNullSafe(F.lag("_f").over(rest))
    df = df.withColumn("_n", F.when(F.col("_loose"), F.col("pos")).otherwise(F.sum(new.cast("int")).over(rest)))
    words = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("")).alias("word"))))
    parts = df.groupBy("doc_id", F.col("_f").alias("field"), "_o", "_loose", "_n").agg(F.min("pos").alias("pos"), F.trim(F.array_join(F.transform(words, lambda x: x["word"]), " ")).alias("text"), F.sum("conf").alias("total"), F.count("conf").alias("n"))
    parts = parts.filter(F.col("_loose") | (F.col("text") != ""))
    steps = F.array_sort(F.collect_list(F.struct("pos", "_loose", "text")))
    text = F.aggregate(steps, F.lit(""), lambda t, x: F.when(x["_loose"], F.concat(t, F.lit(" "), x["text"])).otherwise(x["text"]))
    return parts.groupBy("doc_id", "field").agg(text.alias("text"), (F.sum("total") / F.sum("n")).alias("conf"))


def first_subtoken(subtokens: DataFrame) -> DataFrame:
    """Of the sub-tokens (doc_id, word_id, pos) of a word the first."""
    return subtokens.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "word_id").orderBy("pos"))).filter("_n = 1").drop("_n")


def reading_order(items: Column, gap: int = ROW_GAP) -> Column:
    """An array of struct(x0, y0, pos, ...) in reading order. From top to bottom each item joins the first row whose mean y0 is within `gap`, else it starts a row; rows go by mean, items of a row from left to right."""
    kind = "struct<n:bigint,total:double,row:int,rows:array<int>>"
    # From top to bottom, a row that one item has not reached is out of reach for good: only the last row is open, and rows go by mean as they are
    ordered = F.sort_array(F.transform(items, lambda x, i: F.struct(x["y0"].cast("double").alias("y"), i.alias("i"), x["x0"].alias("x"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        def put(n: Column, total: Column, row: Column) -> Column:
            return F.struct(n.cast("bigint").alias("n"), total.alias("total"), row.alias("row"), F.array_append(s["rows"], row).alias("rows"))

        fits = F.abs(x["y"] - s["total"] / s["n"]) <= gap
        return F.when((s["n"] > 0) & fits, put(s["n"] + 1, s["total"] + x["y"], s["row"])).otherwise(put(F.lit(1), x["y"], s["row"] + 1)).cast(kind)

    rows = F.aggregate(ordered, none, step, lambda s: s["rows"])
    keyed = F.sort_array(F.zip_with(ordered, rows, lambda x, r: F.struct(r.alias("r"), x["x"].alias("x"), x["y"].alias("y"), x["i"].alias("i"))))
    return F.transform(keyed, lambda z: F.get(items, z["i"]))


def label_counts(tags: DataFrame, vocabulary: list[str]) -> DataFrame:
    """label, n, percent (two decimals), zeros kept."""
    spine = tags.sparkSession.createDataFrame([(x,) for x in vocabulary], "tag string")
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    return spine.join(counts, "tag", "left").na.fill(0).withColumn("percent", F.round(100 * F.col("n") / F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1)), 2))
