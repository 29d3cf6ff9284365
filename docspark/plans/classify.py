"""Queries of prediction, routing, fusion and evaluation. Probabilities of three branches are rendered from the keys of all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import numeric as N
from docspark.operators import evaluation as E
from docspark.operators import fusion as U
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


def branches(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, true_label, p0, p1, p2 (probabilities in the order of LABELS)."""
    k = F.col("o_orderkey")
    raw = lambda b: F.array(*[((k * (2 * i + 3 + b) * 7919 + (i + b) * 104729) % 1000 + F.when(k % 5 == i, 400 + 100 * b).otherwise(0) + 1).cast("double") for i in range(5)])
    df = table(spark, d, "orders").select(k.alias("doc_id"), F.element_at(F.array(*map(F.lit, LABELS)), (k % 5 + 1).cast("int")).alias("true_label"), *[raw(b).alias(f"r{b}") for b in range(3)])
    return df.select("doc_id", "true_label", *[N.normalized(F.col(f"r{b}")).alias(f"p{b}") for b in range(3)])


_NAMES = "['" + "', '".join(LABELS) + "']"
_RAW = ", ".join("[" + ", ".join(f"CAST((o_orderkey * {2 * i + 3 + b} * 7919 + {(i + b) * 104729}) % 1000 + (CASE WHEN o_orderkey % 5 = {i} THEN {400 + 100 * b} ELSE 0 END) + 1 AS DOUBLE)" for i in range(5)) + f"] AS r{b}" for b in range(3))
_NORM = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
_BR = f"""raw AS (SELECT o_orderkey AS doc_id, {_NAMES}[o_orderkey % 5 + 1] AS true_label, {_RAW} FROM orders),
br AS (SELECT doc_id, true_label, {", ".join(f"{_NORM(f'r{b}')} AS p{b}" for b in range(3))} FROM raw)"""
_ARG = lambda p: f"{_NAMES}[list_position({p}, list_max({p}))]"
_TWO = lambda p: f"(list_sort({p}, 'DESC')[1] - list_sort({p}, 'DESC')[2])"
_PRED = f"{_BR}, pred AS (SELECT doc_id, true_label, {_ARG('p0')} AS pred_label, {_ARG('p1')} AS spec_pred, p0 AS p, {_TWO('p0')} AS margin FROM br)"


def predictions(spark, d) -> DataFrame:
    b = branches(spark, d)
    spec = b.select("doc_id", N.first_max(F.col("p1"), LABELS).alias("spec_pred"))
    return U.prediction_table(b, "p0", "test", "b0").join(spec, "doc_id")


def _metrics_sql(src: str, by: str = "") -> str:
    b = by + ", " if by else ""
    f1 = lambda x: f"coalesce(2.0 * tp_{x} / nullif(p_{x} + t_{x}, 0), 0)"
    cols = ", ".join(f"count(*) FILTER (true_label = '{x}' AND pred_label = '{x}') AS tp_{x}, count(*) FILTER (pred_label = '{x}') AS p_{x}, count(*) FILTER (true_label = '{x}') AS t_{x}" for x in LABELS)
    pr = ", ".join(f"coalesce(tp_{x} / nullif(p_{x}, 0), 0) AS precision_{x}, coalesce(tp_{x} / nullif(t_{x}, 0), 0) AS recall_{x}" for x in LABELS)
    return f"""c AS (SELECT {b}count(*) AS n, count(*) FILTER (true_label = pred_label) AS ok, {cols} FROM {src} {"GROUP BY " + by if by else ""}),
m AS (SELECT {b}ok / n AS accuracy, ({" + ".join(map(f1, LABELS))}) / {len(LABELS)} AS macro_f1, ({" + ".join(f"{f1(x)} * t_{x}" for x in LABELS)}) / ({" + ".join(f"t_{x}" for x in LABELS)}) AS weighted_f1, {pr},
 coalesce(tp_invoice / nullif(p_invoice, 0), 0) AS invoice_precision, coalesce(tp_invoice / nullif(t_invoice, 0), 0) AS invoice_recall FROM c)"""


def _r(df: DataFrame, n: int = 9) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_M = ["accuracy", "macro_f1", "weighted_f1", *[f"{k}_{x}" for x in LABELS for k in ("precision", "recall")], "invoice_precision", "invoice_recall"]
_ROUND = ", ".join(f"round({c}, 9) AS {c}" for c in _M)


@query(f"WITH {_PRED}, {_metrics_sql('pred')} SELECT {_ROUND} FROM m")
def a11_metrics(spark, d):
    return _r(E.metrics(predictions(spark, d)))


@query(f"WITH {_PRED} SELECT true_label, " + ", ".join(f"count(*) FILTER (pred_label = '{x}') AS {x}" for x in LABELS) + " FROM pred GROUP BY true_label")
def a12_confusion(spark, d):
    return E.confusion(predictions(spark, d))


@query(f"""WITH {_PRED}, l AS (SELECT unnest({_NAMES}) AS label), r AS (SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp, count(*) FILTER (pred_label = label) AS p, count(*) FILTER (true_label = label) AS t FROM l, pred GROUP BY label),
s AS (SELECT label, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(t, 0), 0) AS recall, coalesce(2 * tp / nullif(p + t, 0), 0) AS f1, t AS support FROM r),
u AS (SELECT * FROM s UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM u""")
def a13_report(spark, d):
    return _r(E.report(predictions(spark, d)))


@query(f"""WITH {_PRED}, l AS (SELECT true_label AS label FROM pred UNION SELECT pred_label FROM pred), r AS (SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp, count(*) FILTER (pred_label = label) AS p, count(*) FILTER (true_label = label) AS t FROM l, pred GROUP BY label)
SELECT round(avg(2 * tp / (p + t)), 9) AS macro_f1, round(sum(2 * tp / (p + t) * t) / sum(t), 9) AS weighted_f1 FROM r""")
def a14_present_f1(spark, d):
    return _r(E.present_f1(predictions(spark, d)))


_PAIRS = [("invoice", "budget"), ("budget", "invoice"), ("form", "invoice"), ("invoice", "form")]


@query(f"WITH {_PRED} SELECT t.a AS true_label, t.b AS pred_label, count(doc_id) AS n FROM (VALUES {', '.join(str(x) for x in _PAIRS)}) t(a, b) LEFT JOIN pred ON true_label = t.a AND pred_label = t.b GROUP BY ALL")
def a15_confusion_pairs(spark, d):
    return E.confusion_pairs(predictions(spark, d), _PAIRS)


_ROUTER = f"""{_PRED}, g AS (SELECT *, CASE WHEN true_label IN ('invoice', 'form', 'budget') THEN 'group_a' ELSE 'group_b' END AS true_group, CASE WHEN spec_pred IN ('invoice', 'form', 'budget') THEN 'group_a' ELSE 'group_b' END AS pred_group FROM pred)"""


def _routed(spark, d) -> DataFrame:
    df = predictions(spark, d).withColumns({"true_group": E.group_of(F.col("true_label")), "pred_group": E.group_of(F.col("spec_pred"))})
    return df.withColumn("router_correct", F.col("true_group") == F.col("pred_group"))


@query(f"""WITH {_ROUTER} SELECT 'correct_final' AS category, count(*) FILTER (true_label = pred_label) AS count FROM g UNION ALL SELECT 'wrong_router', count(*) FILTER (true_group <> pred_group) FROM g
UNION ALL SELECT 'wrong_specialist', count(*) FILTER (true_group = pred_group AND true_label <> pred_label) FROM g""")
def a16_p08_error_propagation(spark, d):
    return E.error_propagation(_routed(spark, d))


@query(f"""WITH {_ROUTER}, i AS (SELECT * FROM g WHERE true_label = 'invoice') SELECT 'total' AS category, count(*) AS count FROM i UNION ALL SELECT 'lost_at_router', count(*) FROM i WHERE pred_group <> 'group_a' UNION ALL SELECT 'reached', count(*) FROM i WHERE pred_group = 'group_a'
UNION ALL SELECT 'lost_inside', count(*) FROM i WHERE pred_group = 'group_a' AND pred_label <> 'invoice' UNION ALL SELECT 'correct', count(*) FROM i WHERE pred_label = 'invoice'""")
def a17_label_propagation(spark, d):
    return E.label_propagation(_routed(spark, d))


@query(f"WITH {_ROUTER} SELECT true_group, pred_group, count(*) AS n FROM g WHERE true_group <> pred_group GROUP BY ALL")
def a18_router_errors(spark, d):
    return _routed(spark, d).filter(~F.col("router_correct")).groupBy("true_group", "pred_group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "true_group", "pred_group")


@query(f"WITH {_PRED} SELECT pred_label, CAST(least(19, floor(list_max(p) * 20)) AS INT) AS bin, count(*) AS n FROM pred GROUP BY ALL")
def a20_confidence_histogram(spark, d):
    p = predictions(spark, d).withColumn("top", F.greatest(*[f"confidence_{x}" for x in LABELS]))
    return E.histogram(p, "top", 20, by=("pred_label",))


@query(f"WITH {_BR}, u AS (SELECT 'b0' AS model_name, true_label, {_ARG('p0')} AS pred_label FROM br UNION ALL SELECT 'b1', true_label, {_ARG('p1')} FROM br UNION ALL SELECT 'b2', true_label, {_ARG('p2')} FROM br), {_metrics_sql('u', 'model_name')} SELECT model_name, {_ROUND} FROM m")
def a33_u01_model_comparison(spark, d):
    b = branches(spark, d)
    rows = [U.prediction_table(b, f"p{i}", "test", f"b{i}") for i in range(3)]
    return _r(E.metrics(rows[0].unionByName(rows[1]).unionByName(rows[2]), by=("model_name",)))


@query(f"WITH {_BR}, u AS (SELECT 'b0' AS model_name, true_label, {_ARG('p0')} AS pred_label FROM br UNION ALL SELECT 'b1', true_label, {_ARG('p1')} FROM br UNION ALL SELECT 'b2', true_label, {_ARG('p2')} FROM br), {_metrics_sql('u', 'model_name')} SELECT model_name, round(macro_f1, 9) AS macro_f1 FROM m ORDER BY m.macro_f1 DESC, invoice_recall DESC, accuracy DESC, model_name LIMIT 1")
def w07_best_model(spark, d):
    return U.best_model(a33_u01_model_comparison(spark, d), "model_name").select("model_name", "macro_f1")


@query(f"WITH {_PRED} SELECT doc_id, true_label, pred_label, round(margin, 9) AS margin_top2 FROM pred WHERE true_label <> pred_label ORDER BY margin, doc_id LIMIT 20")
def w04_top_errors(spark, d):
    return _r(U.top_errors(predictions(spark, d)).select("doc_id", "true_label", "pred_label", "margin_top2"))


@query(f"WITH {_BR} SELECT doc_id, {_ARG('p0')} AS a, {_ARG('p1')} AS b, {_ARG('p2')} AS c FROM br")
def w05_argmax(spark, d):
    return branches(spark, d).select("doc_id", *[N.first_max(F.col(f"p{i}"), LABELS).alias(x) for i, x in enumerate("abc")])


@query(f"WITH {_PRED} SELECT doc_id, pred_label, round(p[1], 9) AS confidence_invoice, round(p[2], 9) AS confidence_form, round(p[3], 9) AS confidence_resume, round(p[4], 9) AS confidence_email, round(p[5], 9) AS confidence_budget FROM pred")
def m18_prediction_table(spark, d):
    return _r(predictions(spark, d).select("doc_id", "pred_label", *[f"confidence_{x}" for x in LABELS]))


@query(f"WITH {_PRED} SELECT doc_id, pred_label IN ('invoice', 'form', 'budget') AND (list_max(p) < 0.45 OR margin < 0.1) AS routed, CASE WHEN pred_label IN ('invoice', 'form', 'budget') AND (list_max(p) < 0.45 OR margin < 0.1) THEN spec_pred ELSE pred_label END AS final_label FROM pred")
def p09_specialist_routing(spark, d):
    return U.route(predictions(spark, d), 0.45, 0.1).select("doc_id", "routed", "final_label")


@query(f"WITH {_BR} SELECT doc_id, CASE WHEN p0[1] >= greatest(p0[2], p0[5]) - 0.08 THEN 'invoice' WHEN p0[5] >= p0[2] AND p0[5] >= p0[1] THEN 'budget' WHEN p0[2] >= p0[1] THEN 'form' ELSE 'invoice' END AS label FROM br")
def p10_invoice_override(spark, d):
    at = lambda x: F.get(F.col("p0"), F.lit(LABELS.index(x)))
    return branches(spark, d).select("doc_id", U.invoice_override({x: at(x) for x in E.GROUP_A}).alias("label"))


@query(f"""WITH {_PRED}, grid AS (SELECT c, g, row_number() OVER (ORDER BY c, g) AS place FROM (SELECT unnest([0.45, 0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS c), (SELECT unnest([0.03, 0.05, 0.08, 0.1, 0.12, 0.15]::DOUBLE[]) AS g)),
f AS (SELECT place, c AS confidence, g AS gap, true_label, CASE WHEN pred_label IN ('invoice', 'form', 'budget') AND (list_max(p) < c OR margin < g) THEN spec_pred ELSE pred_label END AS pred_label FROM pred, grid), {_metrics_sql('f', 'place, confidence, gap')}
SELECT confidence, gap, round(macro_f1 + 0.35 * invoice_recall, 9) AS score FROM m ORDER BY round(macro_f1 + 0.35 * invoice_recall, 12) DESC, place LIMIT 1""")
def w08_u05_best_route(spark, d):
    return _r(U.best_route(predictions(spark, d), [0.45, 0.50, 0.55, 0.60, 0.65, 0.70], [0.03, 0.05, 0.08, 0.10, 0.12, 0.15]))


@query(f"WITH {_BR}, f AS (SELECT doc_id, list_transform([1, 2, 3, 4, 5], lambda i: (p0[i] * 0.5 + p1[i] * 0.3 + p2[i] * 0.2) / 1.0) AS q FROM br) SELECT doc_id, " + ", ".join(f"round(q[{i + 1}] / list_sum(q), 9) AS {x}" for i, x in enumerate(LABELS)) + " FROM f")
def m14_weighted_fusion(spark, d):
    q = U.fuse([F.col("p0"), F.col("p1"), F.col("p2")], [0.5, 0.3, 0.2])
    return _r(branches(spark, d).withColumn("q", q).select("doc_id", *[F.get(F.col("q"), F.lit(i)).alias(x) for i, x in enumerate(LABELS)]))


@query()
def m15_best_fusion_weights(spark, d):
    return _r(U.best_weights(branches(spark, d), ["p0", "p1", "p2"]))


@query(f"WITH {_BR} SELECT doc_id, " + ", ".join(f"round(exp(p0[{i + 1}] - list_max(p0)) / list_sum(list_transform(p0, lambda v: exp(v - list_max(p0)))), 9) AS {x}" for i, x in enumerate(LABELS)) + " FROM br")
def f18_softmax(spark, d):
    return _r(branches(spark, d).withColumn("q", N.softmax(F.col("p0"))).select("doc_id", *[F.get(F.col("q"), F.lit(i)).alias(x) for i, x in enumerate(LABELS)]))


@query("""WITH s AS (SELECT median(l_quantity) AS mq, median(l_extendedprice) AS mp, avg(l_quantity) AS aq, avg(l_extendedprice) AS ap, stddev_pop(l_quantity) AS sq, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - aq) / sq, 6) AS l_quantity, round((l_extendedprice - ap) / sp, 6) AS l_extendedprice FROM lineitem, s""")
def f21_scaler(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    cols = ["l_quantity", "l_extendedprice"]
    return _r(N.scale(li, N.fit_scaler(li, cols), cols), 6)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_linenumber - l_orderkey % 9) > 5 THEN 0.0 ELSE 1.0 - abs(l_linenumber - l_orderkey % 9) / 5 END AS score FROM lineitem")
def f20_proximity(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.proximity(F.col("l_linenumber"), F.col("l_orderkey") % 9).alias("score"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def w02_w06_first_per_group(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return U.first_per_group(c, "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"], 3)


@query("SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS \"column\", unnest([round(avg(l_quantity), 6), round(avg(l_extendedprice), 6), round(avg(l_discount), 6)]) AS mean, unnest([round(stddev_samp(l_quantity), 6), round(stddev_samp(l_extendedprice), 6), round(stddev_samp(l_discount), 6)]) AS std, unnest([min(l_quantity), min(l_extendedprice), min(l_discount)]) AS min, unnest([max(l_quantity), max(l_extendedprice), max(l_discount)]) AS max FROM lineitem")
def a26_describe(spark, d):
    return E.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT unnest(['quality', 'toxic']) AS \"column\", unnest([avg((quality IS NULL)::INT), avg((toxic IS NULL)::INT)]) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def a26_missing_rates(spark, d):
    return E.missing_rates(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic"])
