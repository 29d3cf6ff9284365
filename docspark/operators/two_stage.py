"""Extraction in two stages: the region of each field from confident tags, checks of the regions against each other, then the words of the page inside each padded region, cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.numeric import boxes_close, iou
from docspark.operators import cleaning
from docspark.operators.evaluation import FIELDS
from docspark.operators.selection import regions, words_in

# Padding of a field's region, in thousandths of the page.
PADDING = {"invoice_number": 10, "invoice_date": 20, "due_date": 20, "issuer_name": 25, "recipient_name": 25, "total_amount": 15}
#: Overlap from which issuer and recipient cannot both be right; distance of centres below which a due date is part of the number.
OVERLAP, NEAR = 0.5, 50


def plausible(regions_: DataFrame) -> DataFrame:
    """regions (doc_id, field, box and more) without the box of an issuer that covers the recipient's, and of a due date next to the invoice number's."""
    box = lambda f: F.max(F.when(F.col("field") == f, F.col("box"))).alias(f)
    sides = regions_.groupBy("doc_id").agg(*[box(f) for f in ("invoice_number", "due_date", "issuer_name", "recipient_name")])
    parts = lambda f: [F.get(f, F.lit(i)) for i in range(4)]
    bad = sides.select(
        "doc_id",
        F.coalesce(iou(parts("issuer_name"), parts("recipient_name")) > OVERLAP, F.lit(False)).alias("_issuer"),
        F.coalesce(boxes_close(parts("invoice_number"), parts("due_date"), NEAR), F.lit(False)).alias("_due"),
    )
    gone = (F.col("_issuer") & (F.col("field") == "issuer_name")) | (F.col("_due") & (F.col("field") == "due_date"))
    return regions_.join(bad, "doc_id").withColumn("box", F.when(~gone, F.col("box"))).drop("_issuer", "_due")


def two_stage_fields(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id and the six fields. tokens: doc_id, pos, word, field, conf and a box; words: doc_id, pos, word and a box, all of the page. A field without a region, or with no word in it, is ''; a value of which the cleaner leaves nothing is the region's text."""
    boxes = plausible(regions(tokens))
    padded = F.element_at(F.create_map(*[F.lit(x) for f, p in PADDING.items() for x in (f, p)]), F.col("field"))
    crops = words_in(boxes.withColumn("padding", padded), words, F.col("padding"))
    raw = crops.groupBy("doc_id").pivot("field", FIELDS).agg(F.first("text"))
    out = tokens.select("doc_id").distinct().join(raw, "doc_id", "left").na.fill("", FIELDS)
    clean = {"invoice_number": cleaning.invoice_number, "issuer_name": cleaning.name, "recipient_name": cleaning.name, "total_amount": cleaning.amount, "invoice_date": cleaning.date, "due_date": cleaning.date}
    return out.select("doc_id", *[F.coalesce(F.nullif(F.trim(clean[f](F.trim(f))), F.lit("")), F.col(f)).alias(f) for f in FIELDS])
