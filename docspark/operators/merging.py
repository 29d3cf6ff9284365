"""Merging competing extractions of the same document, field by field. Inputs are one row per document and source; joins are on the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fields as V
from docspark.functions.text import DASH
from docspark.operators.evaluation import FIELDS
from docspark.operators.selection import invoice_number

#: Which source goes first, by field, in the merge of three.
PRIORITY = {f: ("two_stage", "improved", "baseline") for f in FIELDS} | {"issuer_name": ("baseline", "improved", "two_stage"), "recipient_name": ("improved", "two_stage", "baseline")}


def side_by_side(extractions: DataFrame, sources: list[str]) -> DataFrame:
    """One row per document with a struct of fields for every source (null where a source has none): one shuffle by document."""
    return extractions.groupBy("doc_id").agg(*[F.max(F.when(F.col("source") == s, F.struct(*FIELDS))).alias(s) for s in sources])


def merge_three(df: DataFrame) -> DataFrame:
    """First non-empty value by PRIORITY; source_<field> says whose; the last source's where all are empty."""
    out = []
    for f in FIELDS:
        values = [F.col(s)[f] for s in PRIORITY[f]]
        full = [~V.is_empty(v) for v in values]
        value = F.when(full[0], values[0]).when(full[1], values[1]).otherwise(F.coalesce(values[2], F.lit("")))
        source = F.when(full[0], PRIORITY[f][0]).when(full[1], PRIORITY[f][1]).otherwise(PRIORITY[f][2])
        out += [value.alias(f), source.alias(f"source_{f}")]
    return df.select("doc_id", *out)


def merge_hybrid(df: DataFrame) -> DataFrame:
    """Two-stage and one-stage results: numbers and totals two-stage first, dates and recipient one-stage, issuer two-stage unless it is garbage."""
    two, one = (lambda f: F.coalesce(F.col("two_stage")[f], F.lit(""))), (lambda f: F.coalesce(F.col("improved")[f], F.lit("")))
    first = lambda a, b: F.when(V.is_empty(a), b).otherwise(a)
    total = first(two("total_amount"), one("total_amount"))
    return df.select(
        "doc_id",
        first(two("invoice_number"), one("invoice_number")).alias("invoice_number"),
        one("invoice_date").alias("invoice_date"),
        one("due_date").alias("due_date"),
        F.when(V.is_empty(two("issuer_name")) | V.is_issuer_garbage(two("issuer_name")), one("issuer_name")).otherwise(two("issuer_name")).alias("issuer_name"),
        one("recipient_name").alias("recipient_name"),
        V.keep_symbol(total, two("total_amount"), one("total_amount")).alias("total_amount"),
    )


def merge_two(df: DataFrame, candidates: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Baseline and improved results: improved first for numbers, dates and totals, baseline first for names; noisy recipients are replaced or cleaned; an issuer that equals the recipient gives way (swap_suspected). Columns `keep` pass through."""
    b, i = F.col("baseline"), F.col("improved")
    first = lambda x, y: F.when(V.is_empty(x), y).otherwise(x)
    cleaned = V.without_noise(b["recipient_name"])
    recipient = (
        F.when(V.is_noisy(b["recipient_name"]), F.when(~V.is_empty(i["recipient_name"]) & ~V.is_noisy(i["recipient_name"]), i["recipient_name"]).otherwise(F.when(V.is_empty(cleaned), b["recipient_name"]).otherwise(cleaned)))
        .otherwise(first(b["recipient_name"], i["recipient_name"]))
    )
    recipient = F.when(V.is_empty(recipient), recipient).otherwise(V.once(F.trim(recipient)))
    number = first(i["invoice_number"], b["invoice_number"])
    fallback = F.try_element_at(F.filter(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: F.trim(c).rlike(r"^[A-Z]{2,}[\-/]?\d{4,}$|(?i)^\dY\dM\dd-\d+$")), F.lit(1)) if candidates is not None else F.lit(None).cast("string")
    number = F.when(V.is_label_only(F.coalesce(number, F.lit(""))), F.coalesce(F.trim(fallback), F.lit(DASH))).otherwise(number)
    total = first(i["total_amount"], b["total_amount"])
    total = F.when(V.is_empty(total), total).otherwise(V.decimal_point(F.trim(total)))
    df = df.select("doc_id", *keep, number.alias("invoice_number"), first(i["invoice_date"], b["invoice_date"]).alias("invoice_date"), first(i["due_date"], b["due_date"]).alias("due_date"), first(b["issuer_name"], i["issuer_name"]).alias("issuer_name"), recipient.alias("recipient_name"), total.alias("total_amount"))
    swap = ~V.is_empty(F.col("issuer_name")) & ~V.is_empty(F.col("recipient_name")) & (F.lower(F.trim("issuer_name")) == F.lower(F.trim("recipient_name")))
    return df.withColumn("swap_suspected", F.coalesce(swap, F.lit(False))).withColumn("issuer_name", F.when(F.col("swap_suspected"), DASH).otherwise(F.col("issuer_name")))


def merge_batch(df: DataFrame, candidates: Column | None = None) -> DataFrame:
    """merge_two for every row, and source_<field>: whether the value is the baseline's, the improved one's, or was made by a rule (cleaned)."""
    text = lambda x: F.coalesce(x, F.lit(""))
    merged = merge_two(df, candidates, ("baseline", "improved"))
    b, i = F.col("baseline"), F.col("improved")

    def label(f: str, value: Column, name: Column) -> Column:
        return F.when(text(F.col(f)) == text(value), name).otherwise("cleaned").alias(f"source_{f}")

    out = []
    for f in ("invoice_number", "invoice_date", "due_date", "total_amount"):
        base = V.is_empty(i[f]) & ~V.is_empty(b[f])
        out.append(label(f, F.when(base, b[f]).otherwise(i[f]), F.when(base, "baseline").otherwise("improved")))
    issuer = F.when(V.is_empty(b["issuer_name"]), i["issuer_name"]).otherwise(b["issuer_name"])
    out.append(label("issuer_name", issuer, F.when(text(issuer) == text(b["issuer_name"]), "baseline").otherwise("improved")))
    x, y = b["recipient_name"], i["recipient_name"]
    noisy, better = V.is_noisy(x), ~V.is_empty(y) & ~V.is_noisy(y)
    cleaned = V.without_noise(x)
    value = F.when(noisy, F.when(better, y).when(V.is_empty(cleaned), x).otherwise(cleaned)).when(V.is_empty(x), y).otherwise(x)
    out.append(label("recipient_name", value, F.when(noisy, F.when(better, "improved").otherwise("cleaned")).when(V.is_empty(x), "improved").otherwise("baseline")))
    return merged.select(*[c for c in merged.columns if c not in ("baseline", "improved")], *out)


# What a date looks like, short codes of invoices, and labels in front of a recipient.
DATE_SHAPE = r"^(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}-[A-Za-z]{3}-\d{2,4})$"
SHORT_CODE = r"\b[A-Z]{2,}-\d{3,}\b"
RECIPIENT_NOISE = r"(?i)\b(?:invoice|bill\s+to|ship\s+to|to|from)\b\s*#?:?"
WORD_CANDIDATE = r"\b[A-Z0-9][A-Z0-9/\-]{2,}\b"


def clean_recipient(x: Column) -> Column:
    """Without labels, codes and marks, written once, and of several capitalised words their last chunk; the value itself if nothing is left, '' for none."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), RECIPIENT_NOISE, " "), SHORT_CODE, " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[#:/]+", " "), r"\s+", " "), F.lit(" ,.-"))
    s = V.once(s, tail=True)
    chunk = F.try_element_at(F.regexp_extract_all(s, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), 0), F.lit(-1))
    return F.when(V.is_empty(x), "").otherwise(F.coalesce(chunk, F.nullif(s, F.lit("")), x))


def post_merge(df: DataFrame) -> DataFrame:
    """The merged fields (FIELDS, structs two_stage and improved, array words) set right: the recipient is cleaned; the invoice number is chosen anew among the merged, both stages' and the words' candidates, unless it says the invoice date; without one, a short code in the recipient's name serves, else the dash. Null words count as none."""
    text = F.array_join(F.coalesce("words", F.array().cast("array<string>")), " ")
    df = df.withColumn("recipient_name", clean_recipient(F.col("recipient_name")))
    one, two = F.col("improved"), F.col("two_stage")
    of = lambda c, f: F.coalesce(c[f], F.lit(""))
    own = F.coalesce("invoice_number", F.lit(""))
    labelled = F.create_map(*[x for k, v in (("invoice_number", own), ("recipient_name", F.col("recipient_name")), ("one_stage_invoice_number", of(one, "invoice_number")), ("two_stage_invoice_number", of(two, "invoice_number"))) for x in (F.lit(k), v)])
    given = F.filter(F.transform(F.array(own, of(one, "invoice_number"), of(two, "invoice_number"), F.col("recipient_name"), of(one, "recipient_name"), of(two, "recipient_name")), lambda v: F.trim(v)), lambda v: v != "")
    df = df.withColumn("_number", invoice_number(own, text, labelled, F.concat(given, F.regexp_extract_all(text, F.lit(WORD_CANDIDATE), 0))))
    plain = lambda x: F.lower(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "[^0-9A-Za-z]", ""))
    date_in = F.trim("_number").rlike(DATE_SHAPE) & F.trim(F.coalesce("invoice_date", F.lit(""))).rlike(DATE_SHAPE) & (plain(F.col("_number")) == plain(F.col("invoice_date")))
    number = F.when(V.is_empty(F.col("_number")) | date_in, F.nullif(F.regexp_extract("recipient_name", SHORT_CODE, 0), F.lit(""))).otherwise(F.col("_number"))
    return df.withColumn("invoice_number", F.coalesce(number, F.lit(DASH))).drop("_number")


def export_rows(df: DataFrame) -> DataFrame:
    """doc_id, field, value: the non-empty fields, for a CSV."""
    return df.unpivot(["doc_id"], FIELDS, "field", "value").filter(~V.is_empty(F.col("value")))
