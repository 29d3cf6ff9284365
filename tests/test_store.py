"""Keyed caches, idempotent intake and model bundles: replays, half-written parts, other columns."""

import json
import os

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from docspark.operators import models as M
from docspark.sources import store as S
from docspark.sources.bundles import load_bundle, save_bundle


def test_keyed_cache_computes_missing_rows_only(spark, tmp_path):
    asked = []

    def compute(df):
        asked.append(sorted(r.id for r in df.collect()))
        return df.select("id", (F.col("x") * 2).alias("y"))

    base = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3)] + [(3, 3.0), (None, 9.0)], "id long, x double")
    cache = S.KeyedCache(spark, str(tmp_path / "c"), "id long, y double", "id")
    assert cache.rows().count() == 0
    want = {(1, 2.0), (2, 4.0), (3, 6.0)}
    assert set(map(tuple, cache.get_or_compute(base, compute).collect())) == want
    assert set(map(tuple, cache.get_or_compute(base, compute).collect())) == want
    assert asked == [[1, 2, 3]]  # the second call computed nothing
    more = base.unionByName(spark.createDataFrame([(4, 4.0)], "id long, x double"))
    again = S.KeyedCache(spark, str(tmp_path / "c"), "id long, y double", "id")  # another session finds it by its folder
    assert set(map(tuple, again.get_or_compute(more, compute).collect())) == {*want, (4, 8.0)}
    assert asked == [[1, 2, 3], [4]]
    assert {r.id for r in again.get_or_compute(base.filter("id < 3"), compute).collect()} == {1, 2}
    assert len(asked) == 2


def test_keyed_cache_ignores_what_was_cut_off(spark, tmp_path):
    cache = S.KeyedCache(spark, str(tmp_path / "c"), "id long, y double", "id")
    base = spark.createDataFrame([(1, 1.0)], "id long, x double")
    compute = lambda df: df.select("id", F.col("x").alias("y"))
    cache.get_or_compute(base, compute)
    spark.createDataFrame([(2, 5.0)], "id long, y double").write.parquet(str(tmp_path / "c/parts/cut-off"))  # no commit
    assert [tuple(r) for r in cache.rows().collect()] == [(1, 1.0)]

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        cache.get_or_compute(base.unionByName(spark.createDataFrame([(3, 1.0)], "id long, x double")), fails)
    assert [tuple(r) for r in cache.rows().collect()] == [(1, 1.0)]
    with pytest.raises(Exception, match="(?i)exist"):
        cache._commit({"version": 1, "part": "x", "keys": 0, "digest": 0})  # a second writer of a version


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, split string, class_name string, text string, error string")


def test_ingest_replays_and_failures(spark, tmp_path):
    path, bad = str(tmp_path / "store"), str(tmp_path / "bad")
    first = [("a", "train", "form", "1", None), ("a", "train", "form", "2", None), ("b", "val", "email", "3", None), ("c", "val", "email", None, "unreadable"), (None, "val", "form", "x", None)]
    for _ in range(2):  # played twice
        S.ingest(batch(spark, first), 0, path, failures=bad)
    second = [("b", "test", "form", "other", None), ("d", "test", "form", "4", None)]
    for _ in range(3):
        S.ingest(batch(spark, second), 1, path, failures=bad)
    got = sorted(tuple(r) for r in S.read_ingested(spark, path).select("doc_id", "split", "class_name", "text").collect())
    assert got == [("a", "train", "form", "1"), ("b", "val", "email", "3"), ("d", "test", "form", "4")]
    errors = sorted((r.doc_id or "", r.error) for r in spark.read.schema("doc_id string, error string").json(bad).collect())
    assert errors == [("", "no key"), ("c", "unreadable")]
    assert os.path.isdir(f"{path}/split=train/class_name=form/batch=0")


def test_ingest_stream(spark, tmp_path):
    schema = "doc_id string, split string, class_name string, text string, error string"
    source = tmp_path / "in"
    source.mkdir()
    for name, rows in (("1", [("a", "train", "form"), ("b", "val", "form")]), ("2", [("a", "train", "form"), ("c", "test", "email")])):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"doc_id": i, "split": s, "class_name": c, "text": name}) for i, s, c in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        S.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), failures=str(tmp_path / "bad")).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in S.read_ingested(spark, str(tmp_path / "out")).collect()) == [("a", "1"), ("b", "1"), ("c", "2")]


def test_split_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "train")], "doc_id string, split string")
    S.write_split_tables(df, str(tmp_path / "s"))
    assert {n: spark.read.option("header", True).csv(str(tmp_path / "s" / n)).count() for n in ("all", "train", "val", "test")} == {"all": 3, "train": 2, "val": 1, "test": 0}
    S.write_reports({"sizes": df.groupBy("split").count(), "none": df.limit(0)}, str(tmp_path / "r"))
    assert [json.loads(x) for x in spark.read.json(str(tmp_path / "r/summary")).first().rows] == [{"split": "train", "count": 2}, {"split": "val", "count": 1}]


def test_bundles_score_alike_and_refuse_other_columns(spark, tmp_path):
    rows = [(i, "abc"[i % 3], [float(i % 3) + (i % 5) / 10, float(i % 7) / 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label string, x array<double>").coalesce(2).withColumn("features", array_to_vector("x"))
    for name, made in {"logistic": M.logistic(df), "svm": M.calibrated_svm(df), "trees": M.boosted_trees(df, rounds=2), "one": M.Constant("a")}.items():
        path = str(tmp_path / name)
        save_bundle(spark, path, made, ["u", "v"], {"a": 0.7})
        loaded, meta = load_bundle(spark.newSession(), path, ["u", "v"])
        score = lambda c: {r.doc_id: (r.pred_label, [round(p, 12) for p in r.probabilities]) for r in c.predict(df).collect()}
        assert score(loaded) == score(made)
        assert (meta["labels"], meta["thresholds"]) == (made.labels, {"a": 0.7})
        with pytest.raises(ValueError, match="'v', 'w'"):
            load_bundle(spark, path, ["u", "w"])
        with pytest.raises(ValueError, match="order"):
            load_bundle(spark, path, ["v", "u"])
        with pytest.raises(ValueError, match="already"):
            save_bundle(spark, path, made, ["u", "v"])
    with pytest.raises(ValueError, match="no bundle"):
        load_bundle(spark, str(tmp_path / "nothing"))
