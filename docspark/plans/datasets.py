"""Queries of data sets: splits, summaries and coverage, reports of spans and confidences, aligned probabilities, two-stage extraction and the first cleaner. They read whole tables of documents, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions.numeric import aligned
from docspark.operators import catalog as C
from docspark.operators import cleaning
from docspark.operators import datasets as D
from docspark.operators import evaluation as E
from docspark.operators import fusion as U
from docspark.operators import merging as M
from docspark.operators import selection as S
from docspark.operators import sequences as Q
from docspark.operators import two_stage as T
from docspark.plans.catalog import _FILES, _TAGS, files, tagged
from docspark.plans.classify import _ARG, _BR, branches
from docspark.plans.extract import _FIRST, _SIDE, extractions
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


_SHARE = lambda a, b: f"({a}::DOUBLE / ({a}::DOUBLE + {b}::DOUBLE))"
_RANKED = lambda rows: f"SELECT k, class_name, (row_number() OVER (PARTITION BY class_name ORDER BY md5('42' || k), k) - 1) / count(*) OVER (PARTITION BY class_name) AS x FROM {rows}"


@query(f"""WITH {_FILES}, c AS (SELECT * FROM f WHERE class_name IS NOT NULL), two AS (SELECT * FROM c WHERE split_original IN ('train', 'test')), one AS (SELECT * FROM c WHERE split_original = 'train'),
carved AS ({_RANKED("one")}), new AS ({_RANKED("one")})
SELECT 'all' AS layout, k, class_name, split_original AS split FROM c
UNION ALL SELECT 'no val', k, class_name, CASE WHEN x < {_SHARE(0.7, 0.15)} THEN 'train' ELSE 'val' END FROM carved
UNION ALL SELECT 'no val', k, class_name, 'test' FROM two WHERE split_original = 'test'
UNION ALL SELECT 'train only', k, class_name, CASE WHEN x < 0.7::DOUBLE THEN 'train' WHEN x < (0.7::DOUBLE + 0.15::DOUBLE) THEN 'val' ELSE 'test' END FROM new""")
def u06_official_splits(spark, d):
    """The same files with all official splits, without val, and with train only."""
    c = C.metadata(files(spark, d)).filter("class_name IS NOT NULL").select("k", "class_name", "split_original")
    cases = {"all": c, "no val": c.filter("split_original IN ('train', 'test')"), "train only": c.filter("split_original = 'train'")}
    parts = [D.official_or_new_split(x, "split_original", "class_name", "k").select(F.lit(name).alias("layout"), "k", "class_name", "split") for name, x in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_FILES} SELECT class_name, split_original, count(*) AS n FROM f WHERE class_name IN ('{"', '".join(E.LABELS)}') GROUP BY ALL")
def p03_required_classes(spark, d):
    return D.require_classes(C.metadata(files(spark, d)), "class_name", E.LABELS).groupBy("class_name", "split_original").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT *, length(text) >= 200 AS s, md5(text) AS hash FROM documents)
SELECT 'all' AS part, NULL AS name, count(*) AS n FROM s UNION ALL SELECT 'selected', NULL, count(*) FILTER (s) FROM s
UNION ALL SELECT 'split', source, count(*) FROM s WHERE s AND source IS NOT NULL GROUP BY source UNION ALL SELECT 'class', lang, count(*) FROM s WHERE s AND lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'duplicates', 'hash', CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) FROM (SELECT count(*) AS n FROM s WHERE s GROUP BY hash)
UNION ALL SELECT 'duplicates', 'head', CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) FROM (SELECT count(*) AS n FROM s WHERE s GROUP BY text[:12])
UNION ALL SELECT 'duplicates', 'absent', NULL""")
def a05_a04_dataset_summary(spark, d):
    """Documents of 200 signs or more by source and language, and groups of equal texts and of equal beginnings."""
    t = table(spark, d, "documents").withColumns({"hash": F.md5(F.col("text").cast("binary")), "head": F.substring("text", 1, 12), "absent": F.lit(None).cast("string")})
    return D.dataset_summary(t, F.length("text") >= 200, "source", "lang", ["hash", "head", "absent"])


@query(r"""SELECT source, count(*) AS n, count(*) FILTER (NOT regexp_matches(t, '\S')) AS empty, round(100 * avg(CASE WHEN regexp_matches(t, '\S') THEN 0 ELSE 1 END), 2) AS empty_percent,
round(avg(length(t)), 2) AS mean_chars, round(avg(len(regexp_extract_all(t, '\S+'))), 2) AS mean_words FROM (SELECT source, CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(text, '') END AS t FROM documents) GROUP BY source""")
def a25_text_coverage(spark, d):
    """Coverage by source, one document in seven (by id) taken as unread."""
    return D.text_coverage(table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text"))), "source")


@query(f"WITH {_TAGS} SELECT field, count(*) AS n, round(avg(conf), 6) AS mean, round(min(conf), 6) AS least, round(max(conf), 6) AS most, round(100 * avg(CASE WHEN conf >= 0.7 THEN 1 ELSE 0 END), 6) AS sure_percent FROM tags WHERE field <> '' GROUP BY field")
def a20_confidence_summary(spark, d):
    s = E.confidence_summary(tagged(spark, d).filter("field IS NOT NULL"), "field")
    return s.select("field", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "sure_percent")])


@query(f"""WITH {_TAGS}, p AS (SELECT doc_id, field, start, CASE WHEN start % 2 = 0 OR field = 'BETA' THEN "end" ELSE "end" + 1 END AS "end" FROM spans),
c AS (SELECT field, (SELECT count(*) FROM p JOIN spans s USING (doc_id, field, start, "end") WHERE p.field = o.field) AS tp, count(*) AS n FROM spans o GROUP BY field),
r AS (SELECT field, tp, n, n AS np, tp / n AS p FROM c)
SELECT field, round(p, 9) AS precision, round(p, 9) AS recall, round(p, 9) AS f1, n AS support FROM r
UNION ALL SELECT 'micro avg', round(sum(tp) / sum(n), 9), round(sum(tp) / sum(n), 9), round(sum(tp) / sum(n), 9), CAST(sum(n) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(p), 9), round(avg(p), 9), CAST(sum(n) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 9), round(sum(p * n) / sum(n), 9), round(sum(p * n) / sum(n), 9), CAST(sum(n) AS BIGINT) FROM r""")
def a28_span_report(spark, d):
    true = Q.spans(tagged(spark, d), strict=True)
    moved = true.withColumn("end", F.when((F.col("start") % 2 == 0) | (F.col("field") == "BETA"), F.col("end")).otherwise(F.col("end") + 1))
    return S.span_report(moved, true).select("field", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""WITH m AS (SELECT label, i, sum(x * (vec_id % 3)) / sum(vec_id % 3) AS m FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i)
SELECT label, i, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12), 6) AS x FROM m""")
def a31_unit_vectors(spark, d):
    """Means of the embeddings of each label by a weight of 0, 1 or 2, of length 1, by place."""
    e = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 3)
    return D.mean_vectors(e, "label", "embedding", "w").select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_KNOWN = ["resume", "invoice", "letter", "budget"]


def _restricted(spark, d):
    b = branches(spark, d)
    return b.withColumn("p0", F.when(F.col("doc_id") % 11 == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.slice("p0", 1, 4)))


_ALIGNED = "list_transform(v, lambda x: x / CASE WHEN list_sum(v) = 0 THEN 1 ELSE list_sum(v) END)"
_VALUES = ", ".join(f"CASE WHEN doc_id % 11 = 0 THEN 0 ELSE p0[{_KNOWN.index(x) + 1}] END" if x in _KNOWN else "0" for x in E.LABELS)


@query(f"WITH {_BR}, a AS (SELECT doc_id, [{_VALUES}] AS v FROM br) SELECT doc_id, " + ", ".join(f"round(({_ALIGNED})[{i + 1}], 9) AS {x}" for i, x in enumerate(E.LABELS)) + " FROM a")
def f19_aligned(spark, d):
    """Probabilities of a model with its own order of labels, one of them unknown here, in the order of ours; some rows have only zeros."""
    p = aligned(F.col("p0"), _KNOWN, E.LABELS)
    return _restricted(spark, d).select("doc_id", p.alias("p")).select("doc_id", *[F.round(F.get("p", F.lit(i)), 9).alias(x) for i, x in enumerate(E.LABELS)])


@query(f"WITH {_BR} SELECT doc_id, true_label, {_ARG('p1')} AS pred_label, 'val' AS split, 'few' AS model_name, " + ", ".join(f"round({f'p0[{_KNOWN.index(x) + 1}]' if x in _KNOWN else '0'}, 9) AS confidence_{x}" for x in E.LABELS) + " FROM br")
def m18_formatted_predictions(spark, d):
    from docspark.functions.numeric import first_max

    b = branches(spark, d)
    b = b.withColumn("pred", first_max(F.col("p1"), list(E.LABELS))).withColumns({f"p_{x}": F.round(F.get("p0", F.lit(i)), 9) for i, x in enumerate(_KNOWN)})
    return U.formatted_predictions(b, "pred", {x: f"p_{x}" for x in _KNOWN if x in E.LABELS}, "val", "few")


def page_words(spark, d):
    """doc_id, pos, word and a box: ten words a line, lines from top to bottom and again from the top."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    x, y = F.col("pos") % 10 * 95 + 10, F.floor(F.col("pos") / 10) * 24 % 960 + 10
    return w.select("doc_id", "pos", "word", x.alias("x0"), y.alias("y0"), (x + 80).alias("x1"), (y + 12).alias("y1"))


def page_tags(spark, d):
    """Three tags of each field, a field every second line; in one document of five the issuer's tags lie on the recipient's, in one of seven the due date's next to the number's."""
    line = F.floor(F.col("pos") / 10)
    field = F.element_at(F.array(*map(F.lit, E.FIELDS)), (line / 2 + 1).cast("int"))
    w = page_words(spark, d).filter((F.col("pos") < 120) & (line % 2 == 0) & (F.col("pos") % 10 < 3)).withColumn("field", field)
    up = F.when((F.col("field") == "issuer_name") & (F.col("doc_id") % 5 == 0), 48).when((F.col("field") == "due_date") & (F.col("doc_id") % 7 == 0), -60).otherwise(0)
    return w.withColumns({"y0": F.col("y0") + up, "y1": F.col("y1") + up, "conf": F.when(F.col("pos") % 10 == 2, 0.5).otherwise(0.9)})


_REGIONS = f"""u AS (SELECT doc_id, unnest(range(len(string_split_regex(text, '\\s+')))) AS pos FROM documents),
t AS (SELECT doc_id, ['{"', '".join(E.FIELDS)}'][pos // 20 + 1] AS field, pos % 10 * 95 + 10 AS x0, pos // 10 * 24 + 10 AS y FROM u WHERE pos < 120 AND pos // 10 % 2 = 0 AND pos % 10 < 3),
m AS (SELECT DISTINCT doc_id FROM t), o AS (SELECT doc_id, field, min(x0) AS x0, max(x0) + 80 AS x1, min(y) + CASE WHEN field = 'issuer_name' AND doc_id % 5 = 0 THEN 48 WHEN field = 'due_date' AND doc_id % 7 = 0 THEN -60 ELSE 0 END AS y0 FROM t WHERE x0 < 200 GROUP BY doc_id, field),
a AS (SELECT m.doc_id, f.field, o.x0, o.y0, o.x1, o.y0 + 12 AS y1 FROM m CROSS JOIN (SELECT unnest(['{"', '".join(E.FIELDS)}']) AS field) f LEFT JOIN o ON o.doc_id = m.doc_id AND o.field = f.field),
i AS (SELECT p.doc_id, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS common, (p.x1 - p.x0) * 12 + (q.x1 - q.x0) * 12 AS areas FROM a p JOIN a q ON p.doc_id = q.doc_id AND p.field = 'issuer_name' AND q.field = 'recipient_name'),
n AS (SELECT p.doc_id, abs(p.x0 + p.x1 - q.x0 - q.x1) < 100 AND abs(p.y0 + p.y1 - q.y0 - q.y1) < 100 AS near FROM a p JOIN a q ON p.doc_id = q.doc_id AND p.field = 'invoice_number' AND q.field = 'due_date'),
b AS (SELECT a.*, coalesce(CASE field WHEN 'issuer_name' THEN 2 * common > areas - common WHEN 'due_date' THEN near END, false) AS gone FROM a JOIN i USING (doc_id) JOIN n USING (doc_id))"""


@query(f"WITH {_REGIONS} SELECT doc_id, field, " + ", ".join(f"CASE WHEN NOT gone THEN {c} END AS {c}" for c in ("x0", "y0", "x1", "y1")) + " FROM b")
def x19_plausible_regions(spark, d):
    r = T.plausible(S.regions(page_tags(spark, d)))
    return r.select("doc_id", "field", *[F.get("box", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query()
def x19_two_stage_fields(spark, d):
    """The six fields of every document from the words inside its padded regions."""
    return T.two_stage_fields(page_tags(spark, d), page_words(spark, d))


_WON = lambda f: f"CASE WHEN {_FIRST(f'i_{f}', 'b_' + f)} = CASE WHEN i_{f} IN ('', '—') AND b_{f} NOT IN ('', '—') THEN b_{f} ELSE i_{f} END THEN CASE WHEN i_{f} IN ('', '—') AND b_{f} NOT IN ('', '—') THEN 'baseline' ELSE 'improved' END ELSE 'cleaned' END AS source_{f}"


@query(f"""WITH {_SIDE}, v AS (SELECT *, {_FIRST("b_issuer_name", "i_issuer_name")} AS iss, {_FIRST("b_recipient_name", "i_recipient_name")} AS rec FROM s)
SELECT doc_id, {", ".join(_WON(f) for f in ("invoice_number", "invoice_date", "due_date", "total_amount"))}, CASE WHEN iss = b_issuer_name THEN 'baseline' ELSE 'improved' END AS source_issuer_name,
CASE WHEN b_recipient_name IN ('', '—') THEN 'improved' ELSE 'baseline' END AS source_recipient_name FROM v""")
def x22_merge_sources(spark, d):
    m = M.merge_batch(M.side_by_side(extractions(spark, d), ["baseline", "improved"]))
    return m.select("doc_id", *[f"source_{f}" for f in E.FIELDS])


_TRIM = "trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_STOP = f"(regexp_matches(trim(lower(t), ':.,-'), '^({'|'.join(cleaning.FIRST_STOPS)})') OR regexp_matches(trim(lower(t), ':.,-'), '^[0-9]+$'))"


@query(rf"""WITH v AS (SELECT doc_id, text, {_TRIM} AS v, list_filter(string_split_regex({_TRIM}, '\s+'), lambda w: w <> '') AS w FROM documents),
r AS (SELECT *, w[coalesce(list_position(list_transform(w, lambda t: NOT list_contains(['{"', '".join(cleaning.FIRST_LABELS)}'], trim(lower(t), ':.,-'))), true), len(w) + 1):] AS rest FROM v),
n AS (SELECT *, rest[:least(4, coalesce(nullif(list_position(list_transform(rest, lambda t: {_STOP}), true), 0) - 1, len(rest)))] AS name FROM r)
SELECT doc_id, CASE WHEN coalesce(text, '') IN ('', '—') THEN '—' ELSE coalesce(nullif(regexp_extract(v, '{cleaning.FIRST_DATE}'), ''), v) END AS invoice_date,
CASE WHEN coalesce(text, '') IN ('', '—') THEN '—' ELSE coalesce(nullif(trim(regexp_extract(v, '{cleaning.FIRST_AMOUNT}')), ''), nullif(regexp_extract(v, '{cleaning.FIRST_NUMBER}'), ''), v) END AS total_amount,
CASE WHEN coalesce(text, '') IN ('', '—') THEN '—' ELSE coalesce(w[-1], v) END AS invoice_number,
CASE WHEN coalesce(text, '') IN ('', '—') THEN '—' WHEN len(name) > 0 THEN trim(array_to_string(name, ' '), ',:. ') ELSE v END AS issuer_name FROM n""")
def v21_first_cleaner(spark, d):
    return table(spark, d, "documents").select("doc_id", *[cleaning.first_cleaner(f, F.col("text")).alias(f) for f in ("invoice_date", "total_amount", "invoice_number", "issuer_name")])
