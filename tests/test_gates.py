"""Cases of the gates that the queries' tables do not hold, and the stacking's held-out accuracy."""

import pytest
from pyspark.sql import functions as F

from docspark.operators import gates as G
from docspark.operators.evaluation import LABELS


def one(df):
    return tuple(df.first())


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "doc_id long")
    assert G.require_columns(df, ["doc_id"]) is df
    with pytest.raises(ValueError, match="text"):
        G.require_columns(df, ["doc_id", "text"], "ocr")
    with pytest.raises(ValueError, match="class_name"):
        G.verify_split(df, df)


def test_split_with_nulls_and_empty(spark):
    split = spark.createDataFrame([(1, "a", "invoice"), (2, None, "form"), (3, "b", None)], "doc_id long, file_path string, class_name string")
    there = spark.createDataFrame([("a",), ("a",)], "file_path string")
    assert one(G.verify_split(split, there)) == (3, 2, 1)
    assert one(G.verify_split(split.limit(0), there)) == (0, 0, 0)


def test_unknown_label_fails(spark):
    ok = spark.createDataFrame([("form",)], "l string")
    assert one(ok.select(G.index_of(F.col("l"), ["budget", "form"]))) == (1,)
    for value in ("memo", None):
        with pytest.raises(Exception, match="unknown label"):
            spark.createDataFrame([(value,)], "l string").select(G.index_of(F.col("l"), ["form"]).alias("i")).collect()
    assert one(ok.select(G.label_of(F.lit(5), ["form"]))) == (None,)


def test_missing_auxiliary_features_fail(spark):
    base = spark.createDataFrame([(1, [0.5])], "doc_id long, p array<double>")
    aux = spark.createDataFrame([(2, [1.0])], "doc_id long, q array<double>")
    with pytest.raises(Exception, match="no auxiliary features"):
        G.combined(base, aux, "doc_id", "p", "q").collect()


def test_default_source(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert one(G.default_source(paths("/r/a/1", "/r/b/1", "/r/b/c/2", "/r/loose", "/other/a/1"), "/r/")) == ("b", 2)
    assert one(G.default_source(paths("/r/a/1", "/r/a/2", "/r/kaggle_extracted/1"), "/r")) == ("kaggle_extracted", 1)
    assert G.default_source(paths("/r/loose"), "/r").count() == 0


def test_class_check_and_fast_path(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "class_name string")
    assert one(G.class_check(df, ["b", "a"])) == (["b"], ["z"])
    rows = [(1, ["x" * 60, None, "y" * 40], {"total": "", "date": "d"}), (2, ["x" * 99], {"total": ""}), (3, None, None), (4, ["x" * 100], {"total": ""})]
    docs = spark.createDataFrame(rows, "doc_id long, pages array<string>, fields map<string,string>").withColumns({"pred_label": F.lit("form"), "probabilities": F.array(*[F.lit(0.2)] * 5)})
    got = {r.doc_id: (r["mode"], r.pred_label, r.confidence, r.fields) for r in G.native_fast_path(docs).collect()}
    assert got == {1: ("native_pdf_text", "invoice", 1.0, {"date": "d"}), 2: ("ocr", "form", 0.2, {"total": ""}), 3: ("ocr", "form", 0.2, None), 4: ("native_pdf_text", "invoice", 1.0, None)}


def test_class_files_without_pages(spark):
    pages = spark.createDataFrame([], "job_at string, page long, label string, file_name string")
    assert {tuple(r) for r in G.class_files(pages).select("label", F.size("files")).collect()} == {(x, 0) for x in LABELS}


def test_stacking_beats_single_branches_on_held_out_rows(spark):
    from docspark.plans.classify import branches
    from docspark.plans.gates import QUERIES

    sf = "/root/testdata/sf0.001"
    share = F.avg(F.expr("true_label = pred_label").cast("double"))
    stack = one(QUERIES["m16_stacking"](spark, sf).agg(share))[0]
    held = branches(spark, sf).filter("doc_id % 2 = 1")
    from docspark.functions.numeric import first_max

    assert stack >= max(one(held.withColumn("pred_label", first_max(F.col(p), LABELS)).agg(share))[0] for p in ("p0", "p1", "p2"))


def test_stacking_gives_an_unseen_label_probability_zero(spark):
    rows = [(i, ["form", "invoice"][i % 2], [float(i % 2), 1.0 - i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, true_label string, p0 array<double>")
    model, known = G.fit_stacking(df, ["p0"])
    out = G.stacking_probabilities(df, model, known, ["p0"], ["budget", "form", "invoice"]).collect()
    assert known == ["form", "invoice"]
    assert all(r.stack[0] == 0 and abs(sum(r.stack) - 1) < 1e-9 and r.stack[1 + r.doc_id % 2] > 0.9 for r in out)


def test_batch_status_rows(spark):
    from docspark.operators.ocr import batch_status

    words = spark.createDataFrame([(1, 80.0), (1, 60.0), (2, 10.0)], "doc_id long, conf double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    cache = spark.createDataFrame([(2, 7, 50.0)], "doc_id long, num_words long, avg_conf double")
    out = batch_status(ids(1, 2, 3, 4).withColumn("source_path", F.lit("p")), words, ids(1, 2, 3), cache)
    assert {r.doc_id: (r.status, r.error, r.num_words, r.avg_conf, r.cache_hit) for r in out.collect()} == {
        1: ("ok", None, 2, 70.0, False),
        2: ("ok", None, 7, 50.0, True),
        3: ("ok", None, 0, 0.0, False),
        4: ("failed", "no OCR output", 0, 0.0, False),
    }
    with pytest.raises(ValueError):
        batch_status(ids(1), words, ids(), cache)


def test_importances_are_the_first_25_in_order(spark):
    from docspark.plans.gates import QUERIES

    rows = QUERIES["w09_top_importances"](spark, "/root/testdata/sf0.001").collect()
    values = [r.importance for r in rows]
    assert len(rows) == 25 and values == sorted(values, reverse=True) and 0 < sum(values) <= 1 + 1e-9
    assert rows[0].feature.startswith("p")
