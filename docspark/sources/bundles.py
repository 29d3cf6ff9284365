"""Bundles: a fitted classifier and what belongs to it, in one folder, for another session. Models are written by Spark's own writers; labels, thresholds and the columns that the classifier was fitted on are one JSON file."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from docspark.operators import models as M
from docspark.sources.store import _fs, exists

_KINDS = {c.__name__: c for c in (M.Constant, M.Fitted, M.Margins, M.Calibrated, M.OneAgainstRest)}


def _models(c: M.Classifier) -> list:
    if isinstance(c, M.Calibrated):
        return [m for p in c.parts for m in p.models]
    return [c.model] if isinstance(c, M.Fitted) else list(getattr(c, "models", []))


def save_bundle(spark: SparkSession, path: str, classifier: M.Classifier, columns: Sequence[str], thresholds: Mapping[str, float] | None = None) -> None:
    """Writes models first and the description last: a folder without a description is no bundle. An existing bundle is an error."""
    path = path.rstrip("/")
    if exists(spark, f"{path}/bundle.json"):
        raise ValueError(f"{path} has a bundle already")
    found = _models(classifier)
    for i, m in enumerate(found):
        m.write().overwrite().save(f"{path}/models/{i}")
    sigmoids = {str(k): list(v) for k, v in classifier.sigmoids.items()} if isinstance(classifier, M.Calibrated) else {}
    parts = len(classifier.parts) if isinstance(classifier, M.Calibrated) else 0
    meta = {"kind": type(classifier).__name__, "labels": classifier.labels, "models": len(found), "parts": parts, "sigmoids": sigmoids, "columns": list(columns), "thresholds": dict(thresholds or {})}
    fs, at = _fs(spark, f"{path}/bundle.json")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()


def load_bundle(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> tuple[M.Classifier, dict]:
    """The classifier and its description; an error for a folder without one, and where the given columns are not those of the fit, in their order."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/bundle.json"):
        raise ValueError(f"{path} has no bundle")
    meta = json.loads(spark.read.option("wholetext", True).text(f"{path}/bundle.json").first()[0])
    if columns is not None and list(columns) != meta["columns"]:
        odd = sorted(set(columns) ^ set(meta["columns"]))
        raise ValueError(f"columns differ from those of the fit: {odd or 'another order'}")
    found = [DefaultParamsReader.loadParamsInstance(f"{path}/models/{i}", spark.sparkContext) for i in range(meta["models"])]
    kind, labels = _KINDS[meta["kind"]], meta["labels"]
    if kind is M.Constant:
        return M.Constant(labels[0]), meta
    if kind is M.Fitted:
        return M.Fitted(found[0], labels), meta
    if kind is M.Calibrated:
        n = meta["models"] // meta["parts"]
        parts = [M.Margins(found[i * n : (i + 1) * n], labels) for i in range(meta["parts"])]
        return M.Calibrated(parts, {int(k): M.Sigmoid(*v) for k, v in meta["sigmoids"].items()}, labels), meta
    return kind(found, labels), meta
