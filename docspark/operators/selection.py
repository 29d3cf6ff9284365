"""Selection and comparison of field values: the invoice number among candidates, regions of fields, and tallies of two extractors against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.fields import candidate, is_label_only, number_rank
from docspark.functions.text import DASH, safe_div
from docspark.operators.evaluation import FIELDS

# Labels before a number in running text, and numbers of addresses.
INVOICE_LABEL = r"(?i)\binvoice\s*(?:#|no\.?|number)\s*[:\-]?\s*([A-Z0-9][A-Z0-9/\-]{1,})\b"
ORDER_LABEL = r"(?i)\b(?:p\.?\s*o\.?\s*#?|purchase\s+order)\s*(?:#|no\.?|number)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9/\-]{1,})\b"
HOUSE_NUMBER = r"(?i)\b(\d{3,4})\b[^\n]{0,40}\b(?:street|st\.|ave|avenue|road|drive|lane|court|square)\b"
#: Least confidence of a tag in a region; padding of a region's box, by field.
REGION_CONFIDENCE = 0.70


def invoice_number(value: Column, raw_text: Column, labelled: Column, candidates: Column) -> Column:
    """The best of several candidates: those under an invoice label if there are any, else all; with a digit, no bare label, no house number of the text; lowest rank, then shortest, then first. The dash if none is left. labelled: map of label to value."""
    none = F.array().cast("array<string>")
    text = F.coalesce(raw_text, F.lit(""))
    entries = F.coalesce(F.map_entries(labelled), F.array().cast("array<struct<key:string,value:string>>"))
    invoice = lambda e: F.lower(e["key"]).contains("invoice")
    order = lambda e: F.lower(e["key"]).contains("p.o") | F.lower(e["key"]).contains("po") | F.lower(e["key"]).contains("purchase order")
    values = lambda cond: F.transform(F.filter(entries, cond), lambda e: e["value"])
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda c: candidate(F.coalesce(c, F.lit("")))), lambda c: c != ""))
    first = clean(F.concat(values(invoice), F.regexp_extract_all(text, F.lit(INVOICE_LABEL), 1)))
    other = F.concat(F.array(F.coalesce(value, F.lit(""))), values(lambda e: ~invoice(e) & ~order(e)), F.coalesce(candidates, none), values(lambda e: ~invoice(e) & order(e)), F.regexp_extract_all(text, F.lit(ORDER_LABEL), 1))
    houses = F.regexp_extract_all(text, F.lit(HOUSE_NUMBER), 1)
    pool = F.filter(F.when(F.size(first) > 0, first).otherwise(clean(other)), lambda c: ~is_label_only(c) & c.rlike("[0-9]") & ~(c.rlike(r"^\d{3,4}$") & F.array_contains(houses, c)))
    ranked = F.array_sort(F.transform(pool, lambda c, i: F.struct(number_rank(c, F.size(first) > 0).alias("r"), F.length(c).alias("l"), i.alias("i"), c.alias("c"))))
    return F.coalesce(F.get(ranked, F.lit(0))["c"], F.lit(DASH))


def regions(tokens: DataFrame, least: float = REGION_CONFIDENCE, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, field, box (null without tokens), confidence (four decimals), words: the union of the boxes of a field's confident tokens (doc_id, pos, word, field, conf, x0, y0, x1, y1); all fields for every document."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"])
    found = tokens.filter(F.col("conf") >= least).groupBy("doc_id", "field").agg(F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("box"), F.round(F.avg("conf"), 4).alias("confidence"), words.alias("words"))
    spine = tokens.select("doc_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    return spine.join(found, ["doc_id", "field"], "left").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "words": F.coalesce("words", F.array().cast("array<string>"))})


def words_in(regions_: DataFrame, words: DataFrame, padding: int | Column, least: int = 10) -> DataFrame:
    """doc_id, field, text: words whose centre lies in the padded box of a field, in order. Boxes narrower or lower than `least` after padding give nothing."""
    b = F.col("box")
    padding = F.lit(padding) if isinstance(padding, int) else padding
    r = regions_.filter("box IS NOT NULL").select("doc_id", "field", *[F.greatest(F.lit(0), b[i] - padding).alias(f"b{i}") for i in (0, 1)], *[F.least(F.lit(1000), b[i] + padding).alias(f"b{i}") for i in (2, 3)])
    r = r.filter((F.col("b2") - F.col("b0") >= least) & (F.col("b3") - F.col("b1") >= least))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = words.join(r, "doc_id").filter(x.between(F.col("b0"), F.col("b2")) & y.between(F.col("b1"), F.col("b3")))
    return inside.groupBy("doc_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("text"))


def tally(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field and counts better, worse, same, both_different of column two_<f> against one_<f>, by the truth true_<f>."""
    v = lambda p, f: F.trim(F.coalesce(F.col(f"{p}_{f}"), F.lit("")))
    x = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v("one", f).alias("a"), v("two", f).alias("b"), v("true", f).alias("t")) for f in fields])).alias("x")).select("x.*")
    known = ~F.col("t").isin("", DASH)
    two, one = known & (F.col("b") == F.col("t")), known & (F.col("a") == F.col("t"))
    kind = F.when(two & ~one, "better").when(one & ~two, "worse").when(F.col("a") == F.col("b"), "same").otherwise("both_different")
    return x.withColumn("k", kind).groupBy("field").pivot("k", ["better", "worse", "same", "both_different"]).count().na.fill(0)


def field_accuracy(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field, accuracy (null without support), support; and a row `overall` over all fields: trimmed, lower-cased values of predicted_<f> and true_<f>."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    x = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), low(f"predicted_{f}").alias("p"), low(f"true_{f}").alias("t")) for f in fields])).alias("x")).select("x.*")
    per = x.groupBy("field").agg(F.count_if((F.col("t") != "") & (F.col("p") == F.col("t"))).alias("ok"), F.count_if(F.col("t") != "").alias("support"))
    every = per.unionByName(per.agg(F.lit("overall").alias("field"), F.sum("ok").alias("ok"), F.sum("support").alias("support")))
    return every.select("field", F.try_divide(F.col("ok").cast("double"), F.nullif(F.col("support"), F.lit(0)).cast("double")).alias("accuracy"), "support")


def harmonic(precision: Column, recall: Column) -> Column:
    """F1, four decimals; 0 when both are 0."""
    return F.bround(safe_div(2 * precision * recall, precision + recall), 4)


def span_f1(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """precision, recall, f1 of spans (doc_id, start, end, field) that agree exactly."""
    keys = ["doc_id", "start", "end", "field"]
    both = predicted.select(*keys, F.lit(1).alias("p")).join(true.select(*keys, F.lit(1).alias("t")), keys, "full")
    c = both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    p, r = safe_div(F.col("tp"), F.col("np")), safe_div(F.col("tp"), F.col("nt"))
    return c.select(p.alias("precision"), r.alias("recall"), safe_div(2 * F.col("tp"), F.col("np") + F.col("nt")).alias("f1"))


def span_report(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """field, precision, recall, f1, support for each field of spans (doc_id, start, end, field), and rows `micro avg` (all spans), `macro avg` (plain mean over fields) and `weighted avg` (by support)."""
    keys = ["doc_id", "start", "end", "field"]
    both = predicted.select(*keys, F.lit(1).alias("p")).join(true.select(*keys, F.lit(1).alias("t")), keys, "full")
    per = both.groupBy("field").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("t").alias("support"))

    def scored(df: DataFrame) -> DataFrame:
        return df.select("field", safe_div(F.col("tp"), F.col("np")).alias("precision"), safe_div(F.col("tp"), F.col("support")).alias("recall"), safe_div(2 * F.col("tp"), F.col("np") + F.col("support")).alias("f1"), "support")

    fields = scored(per)
    micro = scored(per.agg(F.lit("micro avg").alias("field"), *[F.sum(c).alias(c) for c in ("tp", "np", "support")]))
    names = ("precision", "recall", "f1")
    macro = fields.agg(F.lit("macro avg").alias("field"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = fields.agg(F.lit("weighted avg").alias("field"), *[safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return fields.unionByName(micro).unionByName(macro).unionByName(weighted)
