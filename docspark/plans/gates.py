"""Queries of gates, checks, lookups, samples, job history and stacking, over all orders or documents."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import numeric as N
from docspark.operators import evaluation as E
from docspark.operators import fusion as U
from docspark.operators import gates as G
from docspark.plans.catalog import _FILES, files
from docspark.plans.classify import _ARG, _BR, _M, _NAMES, _PRED, _metrics_sql, _r, branches, predictions
from docspark.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LABELS = E.LABELS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 7 = 0) AS missing_files, count(*) FILTER (o_orderkey % 6 IN (0, 3)) AS invalid_labels FROM orders")
def p05_p15_verify_split(spark, d):
    k = F.col("o_orderkey")
    class_name = F.when(k % 6 == 0, "memo").when(k % 6 != 3, F.element_at(F.array(*map(F.lit, LABELS)), (k % 5 + 1).cast("int")))
    split = table(spark, d, "orders").select(k.alias("doc_id"), F.concat(F.lit("/data/"), k).alias("file_path"), class_name.alias("class_name"))
    return G.verify_split(split, split.filter("doc_id % 7 <> 0"))


@query(f"""WITH f AS (SELECT DISTINCT source AS c FROM documents), e AS (SELECT unnest(['web', 'books', 'absent']) AS c)
SELECT (SELECT coalesce(string_agg(c, ',' ORDER BY c), '') FROM e WHERE c NOT IN (SELECT c FROM f WHERE c IS NOT NULL)) AS absent, (SELECT coalesce(string_agg(c, ',' ORDER BY c), '') FROM f WHERE c NOT IN (SELECT c FROM e)) AS unexpected""")
def u09_expected_classes(spark, d):
    out = G.class_check(table(spark, d, "documents"), ["web", "books", "absent"], "source")
    return out.select(*[F.array_join(c, ",").alias(c) for c in ("absent", "unexpected")])


@query(f"WITH {_FILES}, g AS (SELECT split_part(path, '/', 3) AS source, count(*) AS n FROM f GROUP BY 1) SELECT * FROM g ORDER BY source = 'misc' DESC, n DESC, source LIMIT 1")
def s15_default_source(spark, d):
    return G.default_source(files(spark, d), "/data", "misc")


@query(f"WITH {_PRED} SELECT doc_id, true_label FROM pred WHERE pred_label = 'invoice'")
def p11_extraction_gate(spark, d):
    return G.extraction_gate(predictions(spark, d)).select("doc_id", "true_label")


@query(f"""WITH x AS (SELECT doc_id, {_NAMES}[doc_id % 5 + 1] AS l, length(replace(coalesce(text, ''), chr(10), '')) >= 400 AS native, regexp_extract(coalesce(text, ''), '[0-9]+', 0) AS a FROM documents)
SELECT doc_id, CASE WHEN native THEN 'native_pdf_text' ELSE 'ocr' END AS mode, CASE WHEN native THEN 'invoice' ELSE l END AS pred_label, CASE WHEN native THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
 CASE WHEN native THEN nullif(a, '') ELSE a END AS amount FROM x""")
def p12_native_fast_path(spark, d):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    p = F.array(*[F.when(label == x, 0.6).otherwise(0.1) for x in LABELS])
    docs = table(spark, d, "documents").select("doc_id", F.split(text, "\n").alias("pages"), label.alias("pred_label"), p.alias("probabilities"), F.create_map(F.lit("amount"), F.regexp_extract(text, "[0-9]+", 0)).alias("fields"))
    return G.native_fast_path(docs, least=400).select("doc_id", "mode", "pred_label", "confidence", F.try_element_at("fields", F.lit("amount")).alias("amount"))


@query(f"WITH {_PRED} SELECT doc_id, round(list_max(p), 9) AS top FROM pred WHERE list_max(p) < 0.3")
def p13_low_confidence(spark, d):
    top = predictions(spark, d).select("doc_id", F.greatest(*[f"confidence_{x}" for x in LABELS]).alias("top"))
    return G.low_confidence(top, "top", 0.3).select("doc_id", F.round("top", 9).alias("top"))


_ERRORS = [("invoice", "form"), ("form", "invoice"), ("budget", "invoice")]


@query(f"""WITH {_PRED}, x AS (SELECT doc_id, true_label, pred_label, row_number() OVER (PARTITION BY true_label, pred_label ORDER BY doc_id) AS place FROM pred WHERE (true_label, pred_label) IN ({", ".join(map(str, _ERRORS))}))
SELECT x.doc_id, true_label, pred_label, CAST(place AS INT) AS place, substr(coalesce(text, ''), 1, 600) AS text FROM x LEFT JOIN documents USING (doc_id) WHERE place <= 8""")
def p14_j04_error_cases(spark, d):
    pred = predictions(spark, d).select("doc_id", "true_label", "pred_label")
    return G.error_cases(G.attach_text(pred, table(spark, d, "documents")), _ERRORS, 8, 600)


@query(f"WITH {_PRED} SELECT doc_id, pred_label, CASE WHEN pred_label IN ('invoice', 'form') THEN spec_pred END AS spec_pred FROM pred")
def j06_specialist_by_key(spark, d):
    pred = predictions(spark, d)
    judged = pred.filter(F.col("pred_label").isin("invoice", "form")).select("doc_id", F.col("spec_pred").alias("pred_label")).orderBy(F.desc("doc_id"))
    return G.with_specialist(pred.select("doc_id", "pred_label"), judged)


@query("SELECT count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS skipped FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def j07_annotation_lookup(spark, d):
    return G.annotated(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id").distinct(), "doc_id")[1]


@query(f"WITH {_PRED} SELECT doc_id, CAST(list_position({_NAMES}, pred_label) - 1 AS INT) AS at, pred_label AS back FROM pred")
def j10_label_index(spark, d):
    at = predictions(spark, d).select("doc_id", G.index_of(F.col("pred_label"), LABELS).alias("at"))
    return at.withColumn("back", G.label_of(F.col("at"), LABELS))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'INV-' || o_orderkey END AS "invoiceNumber", CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS "issuerName", CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE '' END AS "dueDate" FROM orders""")
def p17_ui_fields(spark, d):
    k = F.col("o_orderkey")
    number = F.when(k % 3 == 1, F.concat(F.lit("INV-"), k)).when(k % 3 == 2, F.concat(F.lit("INV-"), k)).otherwise("")
    fields = F.map_from_arrays(F.array(*map(F.lit, ("invoice_number", "INVOICE_NUMBER", "issuer_name", "ISSUER_NAME"))), F.array(number, F.col("o_orderstatus"), F.lit(None).cast("string"), F.when(k % 2 == 0, "").otherwise(F.col("o_orderpriority"))))
    x = table(spark, d, "orders").select(k.alias("k"), G.ui_fields(F.when(k % 5 != 4, fields)).alias("u"))
    return x.select("k", *[f"u.{c}" for c in ("invoiceNumber", "issuerName", "dueDate")])


@query("""WITH w AS (SELECT o_custkey AS k, [o_orderstatus, o_orderpriority, o_orderstatus, 'F', o_orderpriority] AS l, o_orderkey FROM orders)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS seen FROM w""")
def u04_append_unique(spark, d):
    out = G.append_unique(F.array("o_orderstatus", "o_orderpriority"), F.array(F.col("o_orderstatus"), F.lit("F"), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(out, "|").alias("seen"))


_AXES = {"ngrams": [1, 2], "sublinear": [0, 1], "min_df": [1, 2, 5], "max_df": [90, 95, 100], "scale": [0, 1], "balanced": [0, 1], "c": [25, 50, 100, 200]}


@query("SELECT row_number() OVER (ORDER BY " + ", ".join(_AXES) + ") - 1 AS place, * FROM " + ", ".join(f"(SELECT unnest({v}) AS {k})" for k, v in _AXES.items()))
def u05_grid(spark, d):
    return G.grid(spark, _AXES)


@query(f"""WITH {_PRED}, x AS (SELECT doc_id, list_max(p) >= 0.4 AS high, row_number() OVER (PARTITION BY list_max(p) >= 0.4 ORDER BY md5('42:' || doc_id), doc_id) AS place FROM pred) SELECT doc_id, high FROM x WHERE place <= 10""")
def u08_balanced_sample(spark, d):
    top = predictions(spark, d).select("doc_id", F.greatest(*[f"confidence_{x}" for x in LABELS]).alias("top"))
    return G.balanced_sample(top, "top", 0.4, 10, 42).select("doc_id", "high")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """One page an order, one job a customer."""
    label = F.element_at(F.array(*map(F.lit, [*LABELS, "memo"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderdate").alias("job_at"), F.col("o_orderkey").alias("page"), label.alias("label"), F.concat(F.lit("scan-"), "o_orderkey").alias("file_name"))


_SIX = "['" + "', '".join([*LABELS, "memo"]) + "']"


@query(f"""WITH x AS (SELECT {_SIX}[o_orderkey % 6 + 1] AS label, 'scan-' || o_orderkey AS f, row_number() OVER (PARTITION BY o_orderkey % 6 ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders)
SELECT label, string_agg(f, ',' ORDER BY place) AS files FROM x WHERE place <= 6 AND label <> 'memo' GROUP BY label""")
def w13_class_files(spark, d):
    upper = _pages(spark, d).withColumn("label", F.when(F.col("page") % 2 == 0, F.upper("label")).otherwise(F.col("label")))
    return G.class_files(upper).select("label", F.array_join("files", ",").alias("files"))


@query("SELECT o_custkey AS job, CAST(max(o_orderdate) AS VARCHAR) AS created_at, count(*) AS total_files, count(*) FILTER (" + _SIX + "[o_orderkey % 6 + 1] = 'invoice') AS invoice_pages FROM orders GROUP BY 1")
def w14_a29_job_history(spark, d):
    return G.job_history(_pages(spark, d)).withColumn("created_at", F.col("created_at").cast("string"))


@query(f"WITH {_BR} SELECT doc_id, len(p0) + len(p1) AS n, round(p0[1], 9) AS a, round(p1[5], 9) AS z FROM br")
def m21_combined(spark, d):
    b = branches(spark, d)
    c = G.combined(b.select("doc_id", "p0"), b.select("doc_id", "p1"), "doc_id", "p0", "p1")
    return c.select("doc_id", F.size("combined").cast("long").alias("n"), F.round(F.get("combined", F.lit(0)), 9).alias("a"), F.round(F.get("combined", F.lit(9)), 9).alias("z"))


_VARIANTS = {"first": (1.0, 0.0, 0.0), "second": (0.0, 1.0, 0.0), "third": (0.0, 0.0, 1.0), "first_second": (0.5, 0.5, 0.0), "mean": (1.0, 1.0, 1.0), "weighted": (0.5, 0.3, 0.2)}
_MIX = lambda w: "[" + ", ".join(f"{w[0]} * p0[{i}] + {w[1]} * p1[{i}] + {w[2]} * p2[{i}]" for i in range(1, 6)) + "]"
_ABLATION = " UNION ALL ".join(f"SELECT '{v}' AS variant, CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, true_label, {_ARG(_MIX(w))} AS pred_label FROM br" for v, w in _VARIANTS.items())


@query(f"WITH {_BR}, v AS ({_ABLATION}), {_metrics_sql('v', 'variant, split')} SELECT variant, split, " + ", ".join(f"round({c}, 9) AS {c}" for c in _M) + " FROM m")
def m20_ablation(spark, d):
    b = branches(spark, d).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "val").otherwise("test"))
    label = lambda w: N.first_max(U.fuse([F.col("p0"), F.col("p1"), F.col("p2")], w), LABELS)
    return _r(G.ablation({v: b.withColumn("pred_label", label(w)) for v, w in _VARIANTS.items()}))


@query()
def m16_stacking(spark, d):
    """The meta classifier is fitted on one half of the orders; probabilities and labels of the other half."""
    b = branches(spark, d)
    names = ["p0", "p1", "p2"]
    model, known = G.fit_stacking(b.filter("doc_id % 2 = 0"), names)
    out = G.stacking_probabilities(b.filter("doc_id % 2 = 1"), model, known, names)
    return out.select("doc_id", "true_label", N.first_max(F.col("stack"), LABELS).alias("pred_label"), "stack")


@query()
def w09_top_importances(spark, d):
    """Of a forest over the three branches' probabilities and an array of fifteen digits without meaning, fitted on all orders, the 25 most important features."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(10)).cast("double"))
    x = branches(spark, d).select(array_to_vector(F.concat(G.stacked(["p0", "p1", "p2"]), digits)).alias("x"), G.index_of(F.col("true_label"), LABELS).cast("double").alias("y"))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=6, seed=42).fit(x)
    return G.top_importances(spark, model, [*[f"p{b}_{l}" for b in range(3) for l in LABELS], *[f"digit_{i}" for i in range(15)]])
