"""Gates, checks and lookups between the stages: verification of splits, fast paths, error cases, keyed joins, label maps, samples, job history, stacking. Joins are by key throughout; a row limit stands only where a report of the first n is the feature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.numeric import normalized
from docspark.operators.evaluation import LABELS, metrics
from docspark.sources.files import is_native_pdf

#: Names of invoice fields and their keys in the user interface.
UI_KEYS = {
    "invoice_number": "invoiceNumber",
    "invoice_date": "invoiceDate",
    "due_date": "dueDate",
    "issuer_name": "issuerName",
    "recipient_name": "recipientName",
    "total_amount": "totalAmount",
}


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def verify_split(split: DataFrame, files: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row: rows, missing_files (paths that files (file_path) has not), invalid_labels (null included)."""
    require_columns(split, ("doc_id", "file_path", "class_name"), "split")
    there = files.select("file_path").distinct().withColumn("there", F.lit(True))
    invalid = ~F.coalesce(F.col("class_name").isin(list(labels)), F.lit(False))
    return split.join(there, "file_path", "left").agg(F.count("*").alias("rows"), F.count_if(F.col("there").isNull()).alias("missing_files"), F.count_if(invalid).alias("invalid_labels"))


def class_check(df: DataFrame, expected: Sequence[str], column: str = "class_name") -> DataFrame:
    """One row: expected classes that are absent, and classes that are not expected; sorted arrays."""
    found, want = F.col("found"), F.array(*map(F.lit, expected))
    return df.agg(F.collect_set(column).alias("found")).select(F.sort_array(F.array_except(want, found)).alias("absent"), F.sort_array(F.array_except(found, want)).alias("unexpected"))


def default_source(paths: DataFrame, root: str, preferred: str = "kaggle_extracted") -> DataFrame:
    """The folder below root to read: the preferred one, or that with most files (first name of equals). One row (source, n) or none."""
    below = F.split(F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30), "/")
    dirs = paths.filter(F.col("path").startswith(root.rstrip("/") + "/") & (F.size(below) > 1)).groupBy(F.get(below, F.lit(0)).alias("source")).agg(F.count("*").alias("n"))
    return dirs.orderBy(F.desc(F.col("source") == preferred), F.desc("n"), "source").limit(1)


def extraction_gate(pred: DataFrame, label: str = "invoice") -> DataFrame:
    """Documents that go on to the extraction."""
    return pred.filter(F.col("pred_label") == label)


def native_fast_path(df: DataFrame, labels: Sequence[str] = LABELS, least: int = 100) -> DataFrame:
    """Documents (pages, pred_label, probabilities, fields: map) of whose pages the texts can be read are invoices for sure and keep fields that are not empty; others keep the model's prediction. Adds confidence and mode."""
    native = F.coalesce(is_native_pdf("pages", least), F.lit(False))
    sure = F.array(*[F.lit(1.0 if x == "invoice" else 0.0) for x in labels])
    p = F.when(native, sure).otherwise(F.col("probabilities"))
    kept = F.map_filter("fields", lambda k, v: F.coalesce(v, F.lit("")) != "")
    return df.withColumns(
        {
            "mode": F.when(native, "native_pdf_text").otherwise("ocr"),
            "pred_label": F.when(native, "invoice").otherwise(F.col("pred_label")),
            "confidence": F.array_max(p),
            "probabilities": p,
            "fields": F.when(native, F.when(F.size(kept) > 0, kept)).otherwise(F.col("fields")),
        }
    )


def low_confidence(df: DataFrame, column: str, below: float = 0.5) -> DataFrame:
    """Rows under a confidence, least certain first; a null confidence is none of them."""
    return df.filter(F.col(column) < below).orderBy(column, "doc_id")


def error_cases(pred: DataFrame, pairs: Sequence[tuple[str, str]], n: int, chars: int) -> DataFrame:
    """The first n documents (by id) of each confused pair of labels (true, predicted), with the beginning of the text, for a report."""
    asked = F.struct("true_label", "pred_label").isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs])
    w = W.partitionBy("true_label", "pred_label").orderBy("doc_id")
    return pred.filter(asked).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).withColumn("text", F.substring("text", 1, chars))


def attach_text(base: DataFrame, ocr: DataFrame, key: str = "doc_id") -> DataFrame:
    """base with the OCR text of each document, empty where there is none. ocr has one row for a key."""
    return base.join(ocr.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_specialist(base: DataFrame, specialist: DataFrame, key: str = "doc_id") -> DataFrame:
    """base with the specialist's label as spec_pred, found by key and not by place; null where it has not judged."""
    return base.join(specialist.select(key, F.col("pred_label").alias("spec_pred")), key, "left")


def annotated(base: DataFrame, annotations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their annotation, and one row with the number of both kinds: matched, skipped."""
    marked = base.join(annotations.withColumn("_there", F.lit(True)), key, "left")
    counts = marked.agg(F.count_if(F.col("_there").isNotNull()).alias("matched"), F.count_if(F.col("_there").isNull()).alias("skipped"))
    return marked.filter("_there").drop("_there"), counts


def index_of(label: Column, labels: Sequence[str]) -> Column:
    """Place of a label, from 0; an error for an unknown one. A null label is unknown too."""
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))).cast("int")


def label_of(index: Column, labels: Sequence[str]) -> Column:
    """The label at a place; null outside of the list."""
    return F.get(F.array(*map(F.lit, labels)), index)


def ui_fields(fields: Column) -> Column:
    """Struct of the interface's keys from a map with lower or upper case names: the first value that is not empty, else ''. Null for a null map."""
    value = lambda k: F.try_element_at(fields, F.lit(k))
    pick = lambda k: F.coalesce(F.nullif(value(k), F.lit("")), F.nullif(value(k.upper()), F.lit("")), F.lit(""))
    return F.when(fields.isNotNull(), F.struct(*[pick(k).alias(v) for k, v in UI_KEYS.items()]))


def append_unique(*lists: Column) -> Column:
    """All values in order of their first appearance."""
    return F.array_distinct(F.concat(*lists))


def grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the axes' values, numbered by place with the last axis fastest."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("place"))
    for name, values in axes.items():
        step = F.posexplode(F.array(*map(F.lit, values))).alias("_i", name)
        df = df.select("*", step).withColumn("place", F.col("place") * len(values) + F.col("_i")).drop("_i")
    return df


def balanced_sample(df: DataFrame, column: str, cut: float, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """At most n rows from the cut up and n below it, chosen by a digest of seed and key. Rows with a null value are in neither."""
    high = F.col(column) >= cut
    w = W.partitionBy("high").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key)
    return df.filter(F.col(column).isNotNull()).withColumn("high", high).withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def class_files(pages: DataFrame, labels: Sequence[str] = LABELS, n: int = 6) -> DataFrame:
    """label, files: the first n file names of each label (case ignored) in pages (job_at, page, label, file_name), newest job first; an empty array for a label without pages."""
    named = pages.withColumn("label", F.lower("label")).filter(F.col("label").isin(list(labels)))
    w = W.partitionBy("label").orderBy(F.desc("job_at"), "page")
    first = named.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n)
    files = first.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "file_name"))), lambda x: x["file_name"]).alias("files"))
    every = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    return every.join(files, "label", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def job_history(pages: DataFrame) -> DataFrame:
    """job, created_at, total_files, invoice_pages; newest first."""
    return pages.groupBy("job").agg(F.max("job_at").alias("created_at"), F.count("*").alias("total_files"), F.count_if(F.col("label") == "invoice").alias("invoice_pages")).orderBy(F.desc("created_at"), "job")


def combined(base: DataFrame, aux: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """base with the array `first` followed by aux's array `second` as column combined; an error for a key that aux has not."""
    both = base.join(aux.select(key, second), key, "left")
    there = F.when(F.col(second).isNotNull(), F.col(second)).otherwise(F.raise_error(F.concat(F.lit("no auxiliary features for "), F.col(key).cast("string"))).cast("array<double>"))
    return both.withColumn("combined", F.concat(F.col(first), there)).drop(second)


def stacked(branches: Sequence[str]) -> Column:
    """Probabilities of all branches, in the order of their names, as one array."""
    return F.concat(*[F.col(b) for b in sorted(branches)])


def fit_stacking(val: DataFrame, branches: Sequence[str], label: str = "true_label") -> tuple[LogisticRegressionModel, list[str]]:
    """Meta classifier over the branches' probabilities, and its labels in the alphabet's order."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(val)
    x = index.transform(val.withColumn("_x", array_to_vector(stacked(branches)))).select("_x", "_y")
    return LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=300, regParam=1e-4).fit(x), list(index.labels)


def stacking_probabilities(df: DataFrame, model: LogisticRegressionModel, known: Sequence[str], branches: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """df with the column stack: the meta classifier's probabilities in the order of labels, 0 for one that it has not seen."""
    out = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p").transform(df.withColumn("_x", array_to_vector(stacked(branches))))
    p = vector_to_array("_p")
    aligned = F.array(*[F.get(p, F.lit(list(known).index(x))) if x in known else F.lit(0.0) for x in labels])
    return out.withColumn("stack", normalized(aligned)).drop("_x", "_p")


def ablation(variants: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of each variant's predictions (split, true_label, pred_label), by variant and split, in one aggregation."""
    named = [df.select(F.lit(name).alias("variant"), "split", "true_label", "pred_label") for name, df in variants.items()]
    every = named[0]
    for df in named[1:]:
        every = every.unionByName(df)
    return metrics(every, by=("variant", "split"))


def top_importances(spark: SparkSession, model: RandomForestClassificationModel, names: Sequence[str], n: int = 25) -> DataFrame:
    """feature, importance of the model's n most important features, by name where equal. The model has one number a feature, so this is a short table."""
    values = model.featureImportances.toArray().tolist()
    if len(values) != len(names):
        raise ValueError(f"{len(names)} names for {len(values)} features")
    return spark.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)
