"""Invoice fields by rules over the lines of a page: anchors, zones and validators. Column expressions over one array of lines a document; null where nothing is found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fields as V
from docspark.functions.text import without_ocr_marks
from docspark.operators import layout as L
from docspark.operators.evaluation import FIELDS

# Labels of amounts that are no totals, labels of totals that go first, and what a number looks like in running text.
SUBTOTAL_ANCHORS = ["subtotal", "sub total", "sub-total", "tax", "vat", "gst", "hst", "discount", "shipping", "freight", "handling"]
FIRST_TOTALS = ["grand total", "amount due", "balance due", "total due"]
NUMBER = r"(?i)\b[A-Z]{0,4}[-/]?\d{3,10}(?:[-/][A-Z0-9]{1,8})?\b"
#: Lines looked at: of the seller's zone, of the page, and behind a recipient's label.
SELLER_LINES, PAGE_LINES, AFTER_LABEL = 6, 5, 4


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def anchor_lines(texts: Column, anchors: Sequence[str]) -> Column:
    """Positions (from 0) of the lines that hold an anchor."""
    return F.filter(F.transform(texts, lambda t, i: F.when(L.has_any(t, anchors), i)), lambda i: i.isNotNull())


def anchor_line(texts: Column, anchors: Sequence[str]) -> Column:
    return F.get(anchor_lines(texts, anchors), F.lit(0))


def top_lines(lines: Column, n: int | None = None) -> Column:
    """The n highest lines (all without n); lines of one height in their order."""
    ordered = F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(F.coalesce(x["top"].cast("double"), F.lit(0.0)).alias("top"), x["line_id"].alias("line_id"), x.alias("line")))), lambda x: x["line"])
    return ordered if n is None else F.slice(ordered, 1, n)


def _in(zone: str) -> Column:
    return F.filter("_lines", lambda x: x["zone"] == zone)


def _valid(candidates: Column, check) -> Column:
    """The first candidate that a validator accepts, as it returns it."""
    return _first(F.transform(F.filter(candidates, lambda x: x.isNotNull()), lambda x: check(x)))


def _numbers(texts: Column, full: Column) -> Column:
    behind = lambda text: F.get(F.split(V.after_anchor(text, L.NUMBER_ANCHORS), r"\s+"), F.lit(0))
    at = F.col("_number_line")
    return F.concat(F.transform(_in("metadata"), lambda x: behind(x["text"])), F.array(behind(F.get(texts, at)), F.trim(F.get(texts, at + 1))), F.regexp_extract_all(full, F.lit(NUMBER), 0))


def _dates(texts: Column, at: Column, anchors: Sequence[str]) -> Column:
    """The first date behind the anchor, on its line, on the next line."""
    return F.transform(F.array(V.after_anchor(F.get(texts, at), anchors), F.get(texts, at), F.get(texts, at + 1)), lambda t: F.get(V.dates_in(t), F.lit(0)))


def _issuers() -> Column:
    named = lambda x: F.when(L.has_any(x["text"], L.ISSUER_ANCHORS), V.after_anchor(x["text"], L.ISSUER_ANCHORS)).otherwise(x["text"])
    return F.concat(F.transform(top_lines(_in("seller"), SELLER_LINES), named), F.transform(top_lines(F.col("_lines"), PAGE_LINES), lambda x: x["text"]))


def _recipients(texts: Column, at: Column) -> Column:
    after = F.when(at.isNotNull(), F.transform(F.slice(texts, at + 2, AFTER_LABEL), lambda t: F.trim(t))).otherwise(F.array().cast("array<string>"))
    buyers = F.filter(top_lines(_in("buyer")), lambda x: ~L.has_any(x["text"], L.RECIPIENT_ANCHORS))
    return F.concat(F.array(V.after_anchor(F.get(texts, at), L.RECIPIENT_ANCHORS)), after, F.transform(buyers, lambda x: x["text"]))


def _amounts(text: Column) -> Column:
    return F.filter(F.transform(V.amounts_in(text), lambda x: V.amount(x)), lambda x: x.isNotNull())


def _total(texts: Column) -> Column:
    """struct(amount, symbol): of lines with a total's anchor the best scored (1, with 0.2 in the totals' zone and 0.3 for a first total; the first of equals); without one, the line behind the first such line that has an amount; else the largest amount of the zone."""

    def scored(i: Column) -> Column:
        line = F.get(F.col("_lines"), i)
        score = 1.0 + F.when(line["zone"] == "totals", 0.2).otherwise(0.0) + F.when(L.has_any(line["text"], FIRST_TOTALS), 0.3).otherwise(0.0)
        return F.struct(score.alias("score"), (-i).alias("i"), F.get(_amounts(line["text"]), F.lit(0)).alias("found"))

    places = F.filter("_total_lines", lambda i: ~L.has_any(F.get(texts, i), SUBTOTAL_ANCHORS))
    best = F.array_max(F.filter(F.transform(places, scored), lambda x: x["found"].isNotNull()))["found"]
    after = _first(F.transform(places, lambda i: F.get(_amounts(F.get(texts, i + 1)), F.lit(0))))
    in_zone = _amounts(F.array_join(F.transform(_in("totals"), lambda x: x["text"]), "\n"))
    largest = F.array_max(F.transform(in_zone, lambda x, i: F.struct(x["amount"].cast("double").alias("v"), (-i).alias("i"), x.alias("found"))))["found"]
    return F.coalesce(best, after, largest)


def extract_fields(zoned: DataFrame) -> DataFrame:
    """zoned (doc_id, line_id, text, top, zone), one row a line: one row a document with its six fields, due_date_inferred, currency_symbol and extraction_confidence. A recipient equal to the issuer is null. The lines of one document come together, no more; null texts count as empty."""
    line = F.struct("line_id", "top", "zone", without_ocr_marks(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("text", F.lit("")).alias("raw"))
    df = zoned.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    df = df.withColumns({"_texts": F.transform("_lines", lambda x: x["text"]), "_full": F.trim(F.array_join(F.transform("_lines", lambda x: x["raw"]), "\n"))})
    texts, full = F.col("_texts"), F.col("_full")
    anchors = {"_number_line": L.NUMBER_ANCHORS, "_date_line": L.DATE_ANCHORS, "_due_line": L.DUE_ANCHORS, "_recipient_line": L.RECIPIENT_ANCHORS}
    df = df.withColumns({c: anchor_line(texts, a) for c, a in anchors.items()} | {"_total_lines": anchor_lines(texts, L.TOTAL_ANCHORS), "_any_date": _first(F.transform(V.dates_in(full), lambda x: V.date(x)))})
    df = df.withColumns({"_numbers": _numbers(texts, full), "_dates": _dates(texts, F.col("_date_line"), L.DATE_ANCHORS), "_dues": _dates(texts, F.col("_due_line"), L.DUE_ANCHORS), "_issuers": _issuers(), "_recipients": _recipients(texts, F.col("_recipient_line")), "_total": _total(texts)})
    valid = lambda c, check: _valid(F.col(c), check)
    df = df.withColumns({"invoice_number": valid("_numbers", V.invoice_number), "invoice_date": F.coalesce(valid("_dates", V.date), "_any_date"), "_due": F.coalesce(valid("_dues", V.date), "_any_date"), "issuer_name": valid("_issuers", V.name), "_recipient": valid("_recipients", V.name)})
    terms = V.due_from_terms(F.col("invoice_date"), full)
    df = df.withColumns({"due_date": F.coalesce("_due", terms["due"]), "due_date_inferred": F.col("_due").isNull() & terms["inferred"], "recipient_name": F.when(V.differ(F.col("issuer_name"), F.col("_recipient")), F.col("_recipient")), "total_amount": F.col("_total.amount")})
    return df.select("doc_id", *FIELDS, "due_date_inferred", F.col("_total.symbol").alias("currency_symbol"), V.confidence({f: F.coalesce(f, F.lit("")) for f in FIELDS}).alias("extraction_confidence"))


def extract_batch(asked: DataFrame, zoned: DataFrame) -> DataFrame:
    """A row for each row of asked (doc_id): the fields, or nulls, confidence 0 and an error where the document has no lines."""
    found = extract_fields(zoned.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("_found", F.lit(True))
    df = asked.select("doc_id").join(found, "doc_id", "left")
    return df.select("doc_id", *FIELDS, F.coalesce("due_date_inferred", F.lit(False)).alias("due_date_inferred"), "currency_symbol", F.coalesce("extraction_confidence", F.lit(0.0)).alias("extraction_confidence"), F.when(F.col("_found").isNull(), "no lines").alias("error"))
