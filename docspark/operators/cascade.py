"""A router and a specialist for each group of labels: fitted one after the other, applied so that each row meets one specialist."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.models import Classifier
from docspark.sources.store import stored


def group_of(label: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The group that has a label; null for others."""
    out = F.lit(None).cast("string")
    for g, labels in groups.items():
        out = F.when(label.isin(*labels), g).otherwise(out)
    return out


class Part(NamedTuple):
    """Features for rows (a stored table with `features`), and a classifier on them."""

    featurise: Callable[[DataFrame], DataFrame]
    classifier: Classifier


class Cascade(NamedTuple):
    groups: dict[str, list[str]]
    router: Part
    specialists: dict[str, Part]
    prefer: tuple[str, float] | None

    def infer(self, docs: DataFrame, key: str = "doc_id", label: str | None = None) -> DataFrame:
        """key, true_label and true_group (if docs has a label), pred_group, router_conf_<group>, pred_label, confidence_<label>: 0 for labels of the other groups. Each row goes to the specialist of its predicted group, and to no other. With `prefer` (label, margin) that label wins in its group when it is at most margin behind the best other."""
        names = list(self.router.classifier.labels)
        routed = self.router.classifier.predict(self.router.featurise(docs)).withColumnRenamed("pred_label", "pred_group")
        conf = [F.get("probabilities", F.lit(names.index(g))).alias(f"router_conf_{g}") if g in names else F.lit(0.0).alias(f"router_conf_{g}") for g in self.groups]
        routed = stored(docs.join(routed.select(key, "pred_group", *conf), key), "routed")
        every = [x for labels in self.groups.values() for x in labels]
        truth = [F.col(label).alias("true_label"), group_of(F.col(label), self.groups).alias("true_group")] if label else []
        out = None
        for g in self.groups:
            if g not in self.specialists:
                continue
            part, rows = self.specialists[g], routed.filter(F.col("pred_group") == g)
            known = part.classifier.labels
            p = F.col("probabilities")
            scored = part.classifier.predict(part.featurise(rows)).select(key, "probabilities", "pred_label")
            if self.prefer and self.prefer[0] in known and len(known) > 1:
                first, margin = self.prefer
                others = F.greatest(*[F.get(p, F.lit(i)) for i, x in enumerate(known) if x != first]) if len(known) > 2 else F.get(p, F.lit(1 - known.index(first)))
                scored = scored.withColumn("pred_label", F.when(F.get(p, F.lit(known.index(first))) >= others - margin, first).otherwise(F.col("pred_label")))
            each = [F.get(p, F.lit(known.index(x))).alias(f"confidence_{x}") if x in known else F.lit(0.0).alias(f"confidence_{x}") for x in every]
            done = rows.join(scored, key).select(key, *truth, "pred_group", *[f"router_conf_{x}" for x in self.groups], "pred_label", *each)
            out = done if out is None else out.unionByName(done)
        return out


def fit_cascade(train: DataFrame, groups: Mapping[str, Sequence[str]], router: Callable[[DataFrame], Part], specialist: Mapping[str, Callable[[DataFrame], Part]], label: str = "label", prefer: tuple[str, float] | None = None) -> Cascade:
    """The router is fitted on groups (column `label` of the rows it gets), each specialist on the rows of its own group only, by their true labels. Rows without a group are left out; a group without training rows has no specialist."""
    known = train.withColumn("_group", group_of(F.col(label), groups)).filter("_group IS NOT NULL")
    first = router(known.drop(label).withColumnRenamed("_group", label))
    present = {r[0] for r in known.select("_group").distinct().collect()}
    parts = {g: specialist[g](known.filter(F.col("_group") == g).drop("_group")) for g in groups if g in present}
    return Cascade({g: list(x) for g, x in groups.items()}, first, parts, prefer)
