"""Evaluation: all metrics come from one map-side combined count of (true, predicted) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import letters_and_digits, safe_div

# The classes in their order, and the two groups of the router.
LABELS = ["invoice", "form", "resume", "email", "budget"]
GROUP_A = ["invoice", "form", "budget"]
FIELDS = ["invoice_number", "invoice_date", "due_date", "issuer_name", "recipient_name", "total_amount"]


def pair_counts(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by, "true_label", "pred_label").agg(F.count("*").alias("n"))


def _per_label(label: str) -> tuple[Column, Column, Column]:
    t, p, n = F.col("true_label") == label, F.col("pred_label") == label, F.col("n")
    zero = lambda c: F.sum(F.when(c, n).otherwise(0))
    return zero(t & p), zero(p), zero(t)


def _f1(tp: Column, p: Column, t: Column) -> Column:
    return safe_div(2 * tp, p + t)


def metrics(pred: DataFrame, labels: Sequence[str] = LABELS, by: Sequence[str] = (), invoice: str = "invoice") -> DataFrame:
    """accuracy, macro and weighted F1 over the given labels (also those that are absent), precision and recall of each; undefined ratios are 0."""
    parts = {x: _per_label(x) for x in labels}
    support = sum((v[2] for v in parts.values()), F.lit(0))
    out = [
        safe_div(F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"),
        (sum((_f1(*v) for v in parts.values()), F.lit(0.0)) / len(labels)).alias("macro_f1"),
        safe_div(sum((_f1(*v) * v[2] for v in parts.values()), F.lit(0.0)), support).alias("weighted_f1"),
    ]
    for x, (tp, p, t) in parts.items():
        out += [safe_div(tp, p).alias(f"precision_{x}"), safe_div(tp, t).alias(f"recall_{x}")]
    if invoice in labels:
        tp, p, t = parts[invoice]
        out += [safe_div(tp, p).alias("invoice_precision"), safe_div(tp, t).alias("invoice_recall")]
    return pair_counts(pred, by).groupBy(*by).agg(*out)


def present_f1(pred: DataFrame) -> DataFrame:
    """macro_f1 and weighted_f1 over the labels that occur as true or predicted."""
    c = pair_counts(pred)
    each = c.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x")).select("x.*")
    per = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p")).withColumn("f1", _f1(F.col("tp"), F.col("p"), F.col("t")))
    return per.agg(F.avg("f1").alias("macro_f1"), safe_div(F.sum(F.col("f1") * F.col("t")), F.sum("t")).alias("weighted_f1"))


def confusion(pred: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row per true label in the list, one column per predicted label; other pairs are left out, missing ones are 0."""
    spine = pred.sparkSession.createDataFrame([(x,) for x in labels], "true_label string")
    counts = pair_counts(pred).groupBy("true_label").pivot("pred_label", list(labels)).agg(F.sum("n"))
    return spine.join(counts, "true_label", "left").na.fill(0)


def report(pred: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """label, precision, recall, f1, support, with a row for the macro and one for the weighted average."""
    c = pair_counts(pred)
    stats = c.agg(F.array(*[F.struct(F.lit(x).alias("label"), *[v.alias(k) for k, v in zip(("tp", "p", "t"), _per_label(x), strict=True)]) for x in labels]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    rows = stats.select("label", safe_div(F.col("tp"), F.col("p")).alias("precision"), safe_div(F.col("tp"), F.col("t")).alias("recall"), _f1(F.col("tp"), F.col("p"), F.col("t")).alias("f1"), F.col("t").alias("support"))
    three = ("precision", "recall", "f1")
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(k).alias(k) for k in three], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[safe_div(F.sum(F.col(k) * F.col("support")), F.sum("support")).alias(k) for k in three], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def confusion_pairs(pred: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts of given (true, predicted) pairs, zeros kept."""
    spine = pred.sparkSession.createDataFrame(list(pairs), "true_label string, pred_label string")
    return spine.join(pair_counts(pred), ["true_label", "pred_label"], "left").na.fill(0, ["n"]).orderBy(F.desc("n"), "true_label", "pred_label")


def group_of(label: Column) -> Column:
    return F.when(label.isin(GROUP_A), "group_a").otherwise("group_b")


def error_propagation(pred: DataFrame) -> DataFrame:
    """category, count: right in the end; lost at the router; lost at a specialist."""
    ok, routed = F.col("true_label") == F.col("pred_label"), F.col("router_correct")
    row = pred.agg(F.count_if(ok).alias("correct_final"), F.count_if(~routed).alias("wrong_router"), F.count_if(routed & ~ok).alias("wrong_specialist"))
    return row.unpivot([], ["correct_final", "wrong_router", "wrong_specialist"], "category", "count")


def label_propagation(pred: DataFrame, label: str = "invoice", group: str = "group_a") -> DataFrame:
    own, there = F.col("true_label") == label, F.col("pred_group") == group
    right = F.col("pred_label") == label
    row = pred.agg(F.count_if(own).alias("total"), F.count_if(own & ~there).alias("lost_at_router"), F.count_if(own & there).alias("reached"), F.count_if(own & there & ~right).alias("lost_inside"), F.count_if(own & right).alias("correct"))
    return row.unpivot([], row.columns, "category", "count")


def field_rates(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field, rate: percent of rows whose value is not null, blank or 'None'; one decimal, half to even."""
    ok = lambda f: F.coalesce((F.trim(F.col(f).cast("string")) != "") & (F.col(f).cast("string") != "None"), F.lit(False))
    row = df.agg(*[F.bround(100 * F.avg(ok(f).cast("int")), 1).alias(f) for f in fields])
    return row.unpivot([], list(fields), "field", "rate")


def match_rates(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field, exact, partial, n: percent of rows whose predicted_<field> equals true_<field>, or one holds the other; rows without a true value are skipped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), letters_and_digits(F.col(f"predicted_{f}")).alias("p"), letters_and_digits(F.col(f"true_{f}")).alias("t")) for f in fields]))
    x = df.select(pairs.alias("x")).select("x.*").filter("t <> ''")
    part = (F.col("p") != "") & (F.col("t").contains(F.col("p")) | F.col("p").contains(F.col("t")))
    return x.groupBy("field").agg(F.bround(100 * F.avg((F.col("p") == F.col("t")).cast("int")), 1).alias("exact"), F.bround(100 * F.avg(part.cast("int")), 1).alias("partial"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, lo: float = 0.0, hi: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """bin (from 0; the last includes its upper end), n."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / (hi - lo) * bins)).cast("int")
    return df.filter(F.col(column).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def confidence_summary(df: DataFrame, by: str, column: str = "conf", sure: float = 0.70) -> DataFrame:
    """by, n, mean, least, most, and the percent of rows of `sure` or more; rows without a value do not count."""
    c = F.col(column)
    return df.filter(c.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), (100 * F.avg((c >= sure).cast("int"))).alias("sure_percent"))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "missing")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, mean, std (sample), min, max."""
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")) for c in columns]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")
