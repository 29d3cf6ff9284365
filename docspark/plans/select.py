"""Queries of selection and comparison of field values."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import evaluation as E
from docspark.operators import merging as M
from docspark.operators import selection as S
from docspark.operators import sequences as Q
from docspark.plans.catalog import _TAGS, tagged
from docspark.plans.extract import _R, _SIDE, extractions, rendered
from docspark.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_R} SELECT k, CASE k % 4 WHEN 0 THEN 'US-' || printf('%03d', k % 1000) WHEN 1 THEN '—' WHEN 2 THEN 'INV-' || (k + 10000) ELSE CAST(k + 100000 AS VARCHAR) END AS number FROM r")
def x16_invoice_number(spark, d):
    k = F.col("k")
    house = (1000 + k % 1000).cast("string")
    us = F.concat(F.lit("US-"), F.format_string("%03d", k % 1000))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Invoice # "), us, F.lit(" P.O.# 2312/2019 Address: "), house, F.lit(" Harvest Lane")))
        .when(k % 4 == 1, F.concat(F.lit("Bill To: ACME Corp, "), house, F.lit(" Harvest Lane")))
        .otherwise(F.lit("nothing here"))
    )
    value = F.when(k % 4 == 3, F.lit("INVOICE")).otherwise(house)
    labelled = F.when(k % 4 == 2, F.create_map(F.lit("Invoice No"), F.concat(F.lit("INV-"), k + 10000), F.lit("P.O."), F.lit("77"))).otherwise(F.create_map(F.lit("Other"), F.lit("")))
    extra = F.when(k % 4 == 3, F.array(F.lit("INVOICE"), (k + 100000).cast("string"))).otherwise(F.array(house))
    return rendered(spark, d).select("k", S.invoice_number(value, text, labelled, extra).alias("number"))


def boxed(spark, d):
    t = tagged(spark, d)
    p = F.col("pos")
    return t.filter("field IS NOT NULL").select("doc_id", "pos", "word", F.lower("field").alias("field"), "conf", (p * 37 % 900).cast("int").alias("x0"), (p * 11 % 900).cast("int").alias("y0"), (p * 37 % 900 + 40).cast("int").alias("x1"), (p * 11 % 900 + 12).cast("int").alias("y1"))


@query(f"""WITH {_TAGS}, b AS (SELECT doc_id, lower(field) AS field, conf, pos * 37 % 900 AS x0, pos * 11 % 900 AS y0 FROM tags WHERE field <> ''), f AS (SELECT doc_id, field, min(x0) AS x0, min(y0) AS y0, max(x0) + 40 AS x1, max(y0) + 12 AS y1, round(avg(conf), 4) AS confidence FROM b WHERE conf >= 0.7 GROUP BY ALL),
sp AS (SELECT DISTINCT b.doc_id, unnest(['alpha', 'beta', 'delta']) AS field FROM b) SELECT doc_id, field, x0, y0, x1, y1, coalesce(confidence, 0) AS confidence FROM sp LEFT JOIN f USING (doc_id, field)""")
def a30_x19_regions(spark, d):
    r = S.regions(boxed(spark, d), fields=["alpha", "beta", "delta"])
    return r.select("doc_id", "field", *[F.get("box", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "confidence")


@query(f"""WITH {_SIDE}, u AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, i_{f} AS a, t_{f} AS b, b_{f} AS t FROM s" for f in E.FIELDS)}),
k AS (SELECT field, CASE WHEN t NOT IN ('', '—') AND b = t AND a <> t THEN 'better' WHEN t NOT IN ('', '—') AND a = t AND b <> t THEN 'worse' WHEN a = b THEN 'same' ELSE 'both_different' END AS k FROM u)
SELECT field, count(*) FILTER (k = 'better') AS better, count(*) FILTER (k = 'worse') AS worse, count(*) FILTER (k = 'same') AS same, count(*) FILTER (k = 'both_different') AS both_different FROM k GROUP BY field""")
def a27_tally(spark, d):
    s = M.side_by_side(extractions(spark, d), ["baseline", "improved", "two_stage"])
    cols = [F.col(src)[f].alias(f"{p}_{f}") for f in E.FIELDS for src, p in (("improved", "one"), ("two_stage", "two"), ("baseline", "true"))]
    return S.tally(s.select(*cols))


@query(f"""WITH {_SIDE}, u AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, lower(i_{f}) AS p, lower(t_{f}) AS t FROM s" for f in E.FIELDS)}),
f AS (SELECT field, count(*) FILTER (t <> '' AND p = t) AS ok, count(*) FILTER (t <> '') AS support FROM u GROUP BY field), o AS (SELECT * FROM f UNION ALL SELECT 'overall', CAST(sum(ok) AS BIGINT), CAST(sum(support) AS BIGINT) FROM f)
SELECT field, ok / nullif(support, 0) AS accuracy, support FROM o""")
def a22_field_accuracy(spark, d):
    s = M.side_by_side(extractions(spark, d), ["improved", "two_stage"])
    return S.field_accuracy(s.select(*[F.col("improved")[f].alias(f"predicted_{f}") for f in E.FIELDS], *[F.col("two_stage")[f].alias(f"true_{f}") for f in E.FIELDS]))


@query("SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE 2 * l_discount * l_tax / (l_discount + l_tax) END, 4) AS f1 FROM lineitem")
def a32_harmonic(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.harmonic(F.col("l_discount"), F.col("l_tax")).alias("f1"))


@query(f"""WITH {_TAGS}, p AS (SELECT doc_id, field, start, CASE WHEN start % 2 = 0 THEN "end" ELSE "end" + 1 END AS "end" FROM spans), c AS (SELECT (SELECT count(*) FROM p JOIN spans USING (doc_id, field, start, "end")) AS tp, (SELECT count(*) FROM p) AS n)
SELECT round(tp / n, 9) AS precision, round(tp / n, 9) AS recall, round(tp / n, 9) AS f1 FROM c""")
def a28_span_f1(spark, d):
    true = Q.spans(tagged(spark, d), strict=True)
    moved = true.withColumn("end", F.when(F.col("start") % 2 == 0, F.col("end")).otherwise(F.col("end") + 1))
    return S.span_f1(moved, true).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
