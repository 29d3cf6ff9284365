"""One answer for every upload: checks in order, the native path, the model's path with its fallback. A row that fails gets a status and an error; the others go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.evaluation import FIELDS
from docspark.operators.native import native_fields
from docspark.sources.files import is_native_pdf

# The endings that are accepted.
ENDINGS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp", ".avif", ".pdf")
OK, BAD, UNREADABLE, FAILED, NO_MODELS = 200, 400, 422, 500, 503


def ending(filename: Column) -> Column:
    """The last part of a name from its dot on, in lower case; empty without one, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(F.coalesce(filename, F.lit("upload")), r"[^/.][^/]*(\.[^./]+)$", 1))


def answers(uploads: DataFrame, least: int = 100) -> DataFrame:
    """filename, status, predicted_class, confidence, is_invoice, fields (map), mode, error; further columns of uploads stand first.

    uploads: filename, size (bytes), readable (whether the content can be opened), pages (array of texts of a native PDF, null for
    images), models_ready, pred_label (null where the classifier failed) with confidence, hybrid (map of fields, null where the main
    extractor failed) and one_stage (map of the fallback). In this order a row fails for its ending (400), missing models (503), no
    content (400), content that cannot be opened (422), a failed classifier or, for an invoice, two failed extractors (500). A PDF
    with `least` signs of text is an invoice for sure and needs neither classifier nor extractor. Where the main extractor fails,
    the fallback's fields stay, and the error says so. Nulls: of size as 0, of readable and models_ready as false."""
    used = ["filename", "size", "readable", "pages", "models_ready", "pred_label", "confidence", "hybrid", "one_stage"]
    others = [c for c in uploads.columns if c not in used]
    native = F.coalesce((ending(F.col("filename")) == ".pdf") & is_native_pdf("pages", least), F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = uploads.withColumn("_native", native)
    df = native_fields(df.select(F.struct(*uploads.columns).alias("u"), "_native", F.when(F.col("_native"), F.array_join("pages", "\n")).alias("_page")), "_page")
    own = F.map_filter(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())
    df = df.select("u.*", "_native", own.alias("_fields"))
    invoice = F.col("pred_label") == "invoice"
    lost = invoice & F.col("hybrid").isNull()
    status = (
        F.when(~ending(F.col("filename")).isin(*ENDINGS), BAD)
        .when(~true("models_ready"), NO_MODELS)
        .when(F.coalesce("size", F.lit(0)) <= 0, BAD)
        .when(F.col("_native"), OK)
        .when(~true("readable"), UNREADABLE)
        .when(F.col("pred_label").isNull() | (lost & F.col("one_stage").isNull()), FAILED)
        .otherwise(OK)
    )
    df = df.withColumn("status", status)
    good, by_model = F.col("status") == OK, (F.col("status") == OK) & ~F.col("_native")
    label = F.when(good, F.when(F.col("_native"), "invoice").otherwise(F.col("pred_label")))
    fields = F.when(good & F.col("_native"), F.when(F.size("_fields") > 0, F.col("_fields"))).when(by_model & invoice, F.coalesce("hybrid", "one_stage"))
    mode = F.when(good, F.when(F.col("_native"), "native_pdf_text").when(lost, "one_stage_fallback").when(invoice, "hybrid").otherwise("classified"))
    error = (
        F.when(F.col("status") == NO_MODELS, "models are not loaded")
        .when((F.col("status") == BAD) & ~ending(F.col("filename")).isin(*ENDINGS), F.concat(F.lit("unsupported file type "), ending(F.col("filename"))))
        .when(F.col("status") == BAD, "file is empty")
        .when(F.col("status") == UNREADABLE, "file cannot be opened")
        .when(F.col("status") == FAILED, "inference failed")
        .when(by_model & lost, "main extractor failed; fields are the fallback's")
    )
    return df.select(*others, "filename", "status", label.alias("predicted_class"), F.when(good, F.when(F.col("_native"), F.lit(1.0)).otherwise(F.col("confidence"))).alias("confidence"), F.coalesce(label == "invoice", F.lit(False)).alias("is_invoice"), fields.alias("fields"), mode.alias("mode"), error.alias("error"))
