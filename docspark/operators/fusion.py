"""Predictions: argmax, routing, fusion of branches, and searches over grids of thresholds and weights. A grid is scored in one aggregation over all of its points, not in a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.numeric import first_max, margin, normalized
from docspark.operators.evaluation import GROUP_A, LABELS, metrics


def prediction_table(df: DataFrame, probabilities: str, split: str, model: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """doc_id, true_label, pred_label, split, model_name and a confidence column for each label."""
    p = F.col(probabilities)
    return df.select("doc_id", "true_label", first_max(p, list(labels)).alias("pred_label"), F.lit(split).alias("split"), F.lit(model).alias("model_name"), *[F.get(p, F.lit(i)).alias(f"confidence_{x}") for i, x in enumerate(labels)])


def formatted_predictions(df: DataFrame, predicted: str, probabilities: dict[str, str], split: str, model: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """The prediction table of a model that knows some labels only: predicted is its label column, probabilities maps labels to columns; other labels have confidence 0."""
    confidences = [(F.col(probabilities[x]) if x in probabilities else F.lit(0.0)).alias(f"confidence_{x}") for x in labels]
    return df.select("doc_id", "true_label", F.col(predicted).alias("pred_label"), F.lit(split).alias("split"), F.lit(model).alias("model_name"), *confidences)


def _confidences(labels: Sequence[str]) -> Column:
    return F.array(*[F.col(f"confidence_{x}") for x in labels])


def top_errors(pred: DataFrame, k: int = 20, labels: Sequence[str] = LABELS) -> DataFrame:
    """The k wrong predictions with the smallest margin, ties by id."""
    return pred.withColumn("margin_top2", margin(_confidences(labels))).filter(F.col("true_label") != F.col("pred_label")).orderBy("margin_top2", "doc_id").limit(k)


def route(pred: DataFrame, confidence: Column | float, gap: Column | float, labels: Sequence[str] = LABELS, specialists: Sequence[str] = GROUP_A) -> DataFrame:
    """Uncertain predictions of the specialists' labels take the specialist's (column spec_pred)."""
    p = _confidences(labels)
    df = pred.withColumns({"top1_confidence": F.array_max(p), "top2_margin": margin(p)})
    unsure = (F.col("top1_confidence") < confidence) | (F.col("top2_margin") < gap)
    df = df.withColumn("routed", F.col("pred_label").isin(list(specialists)) & unsure)
    return df.withColumn("final_label", F.when(F.col("routed"), F.col("spec_pred")).otherwise(F.col("pred_label")))


def best_route(pred: DataFrame, confidences: Sequence[float], gaps: Sequence[float], weight: float = 0.35) -> DataFrame:
    """The first grid point with the highest macro F1 plus weighted invoice recall: confidence, gap, score."""
    grid = F.explode(F.array(*[F.struct(F.lit(i * len(gaps) + j).alias("place"), F.lit(float(c)).alias("confidence"), F.lit(float(g)).alias("gap")) for i, c in enumerate(confidences) for j, g in enumerate(gaps)]))
    p = pred.withColumn("g", grid)
    final = route(p, F.col("g.confidence"), F.col("g.gap")).select(F.col("g.place").alias("place"), F.col("g.confidence").alias("confidence"), F.col("g.gap").alias("gap"), "true_label", F.col("final_label").alias("pred_label"))
    m = metrics(final, by=("place", "confidence", "gap"))
    return m.withColumn("score", F.round(F.col("macro_f1") + weight * F.col("invoice_recall"), 12)).orderBy(F.desc("score"), "place").limit(1).select("confidence", "gap", "score")


def invoice_override(p: dict[str, Column], slack: float = 0.08) -> Column:
    """Of the three classes of group A the most probable one (first in the alphabet of equals), but invoice when it is at most `slack` behind."""
    names = sorted(p)
    top = first_max(F.array(*[p[n] for n in names]), names)
    return F.when(p["invoice"] >= F.greatest(p["form"], p["budget"]) - slack, "invoice").otherwise(top)


def fuse(branches: Sequence[Column], weights: Sequence[float | Column]) -> Column:
    """Weighted mean of probability arrays, made to sum to 1; negative weights count as 0."""
    ws = [F.greatest(F.lit(0.0), w if isinstance(w, Column) else F.lit(float(w))) for w in weights]
    total = sum(ws[1:], ws[0])
    mixed = F.transform(branches[0], lambda v: v * ws[0])
    for b, w in zip(branches[1:], ws[1:], strict=True):
        mixed = F.zip_with(mixed, b, _plus(w))
    return normalized(F.transform(mixed, lambda v: v / total))


def _plus(w: Column):
    return lambda a, v: a + v * w


def best_weights(df: DataFrame, branches: Sequence[str], steps: int = 10, labels: Sequence[str] = LABELS) -> DataFrame:
    """The first point of the weight simplex of three branches (steps of 1 / steps) with the highest macro F1: w0, w1, w2, score."""
    points = [(i, j, steps - i - j) for i in range(steps + 1) for j in range(steps + 1 - i)]
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("place"), *[F.lit(x / steps).alias(f"w{m}") for m, x in enumerate(p)]) for n, p in enumerate(points)]))
    # plain columns keep the whole grid inside generated code; the sum of the weights is 1 at every point
    flat = [F.get(F.col(b), F.lit(i)).alias(f"{b}_{i}") for b in branches for i in range(len(labels))]
    g = df.select("true_label", *flat).withColumn("g", grid).select("g.*", "*")
    mixed = [sum((F.col(f"{b}_{i}") * F.col(f"w{m}") for m, b in enumerate(branches)), F.lit(0.0)).alias(f"m{i}") for i in range(len(labels))]
    top = F.greatest(*[f"m{i}" for i in range(len(labels))])
    first = F.coalesce(*[F.when(F.col(f"m{i}") == top, x) for i, x in enumerate(labels)])
    pred = g.select("place", "w0", "w1", "w2", "true_label", *mixed).withColumn("pred_label", first)
    m = metrics(pred, labels, by=("place", "w0", "w1", "w2"))
    return m.withColumn("score", F.round("macro_f1", 12)).orderBy(F.desc("score"), "place").limit(1).select("w0", "w1", "w2", "score")


def best_model(rows: DataFrame, position: str) -> DataFrame:
    """The first row with the highest macro F1, then invoice recall, then accuracy."""
    return rows.orderBy(F.desc("macro_f1"), F.desc("invoice_recall"), F.desc("accuracy"), position).limit(1)


def first_per_group(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
