"""Queries of the OCR and layout operators. The driver has no images, so raw OCR rows are rendered from the texts of all documents: ten words a line, six lines a block, forty lines a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import numeric as N
from docspark.operators import layout, ocr, records
from docspark.session import table
from docspark.sources.store import by_key

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WIDTH, HEIGHT = 1000, 1400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def raw_words(spark: SparkSession, d: str) -> DataFrame:
    words = by_key(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("j", "text"))
    j, n, k = F.col("j"), F.length("text"), F.col("doc_id")
    line = F.floor(j / 10).cast("int")
    return words.select(
        "doc_id",
        "text",
        j.alias("word_num"),
        (F.floor(line / 40) + 1).cast("int").alias("page_num"),
        F.floor(line / 6).cast("int").alias("block_num"),
        F.lit(0).alias("par_num"),
        line.alias("line_num"),
        ((j % 10) * 95 + (n * 7) % 13).alias("left"),
        ((line % 40) * 32 + 5 * ((j * 7) % 3)).alias("top"),
        (n * 8).alias("width"),
        (18 + j % 5).alias("height"),
        ((k * 31 + j * 17) % 101 - 1).cast("double").alias("conf"),
    )


_RAW = r"""
t AS (SELECT doc_id, string_split_regex(text, '\s+') AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS j FROM t),
raw AS (SELECT doc_id, text, j AS word_num, j // 400 + 1 AS page_num, j // 60 AS block_num, 0 AS par_num, j // 10 AS line_num,
  (j % 10) * 95 + (length(text) * 7) % 13 AS "left", ((j // 10) % 40) * 32 + 5 * ((j * 7) % 3) AS top,
  length(text) * 8 AS width, 18 + j % 5 AS height, CAST((doc_id * 31 + j * 17) % 101 - 1 AS DOUBLE) AS conf FROM u),
words AS (SELECT *, "left" + width AS "right", top + height AS bottom, "left" / 1000 AS norm_left, top / 1400 AS norm_top, width / 1000 AS norm_width, height / 1400 AS norm_height,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_num, par_num, line_num, "left", top, word_num) - 1 AS word_id
  FROM raw WHERE trim(text) <> '' AND conf >= 0)"""
_LINES = """,
lines AS (SELECT doc_id, page_num, block_num, par_num, line_num, min("left") AS "left", min(top) AS top, max("right") - min("left") AS width, max(bottom) - min(top) AS height,
  max("right") AS "right", max(bottom) AS bottom, string_agg(text, ' ' ORDER BY "left", top, word_id) AS text, count(*) AS n_words,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_num, par_num, line_num) - 1 AS line_id
  FROM words GROUP BY doc_id, page_num, block_num, par_num, line_num)"""
_BLOCKS = """,
blocks AS (SELECT doc_id, page_num, block_num, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, string_agg(text, chr(10) ORDER BY top, "left", line_id) AS text,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_num) - 1 AS block_id FROM lines GROUP BY doc_id, page_num, block_num)"""


def words(spark, d) -> DataFrame:
    return ocr.prepare_words(raw_words(spark, d), F.lit(WIDTH), F.lit(HEIGHT))


def lines(spark, d) -> DataFrame:
    return ocr.lines(words(spark, d))


@query(f'WITH {_RAW} SELECT doc_id, word_id, text, conf, "left", top, "right", bottom, norm_left, norm_top FROM words')
def x31_prepare_words(spark, d):
    return words(spark, d).select("doc_id", F.col("word_id").cast("long").alias("word_id"), "text", "conf", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom")], "norm_left", "norm_top")


@query(f'WITH {_RAW}{_LINES} SELECT doc_id, line_id, text, "left", top, "right", bottom, width, height, n_words FROM lines')
def a06_lines(spark, d):
    return lines(spark, d).select("doc_id", F.col("line_id").cast("long").alias("line_id"), "text", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom", "width", "height")], F.size("word_ids").cast("long").alias("n_words"))


@query(f'WITH {_RAW}{_LINES}{_BLOCKS} SELECT doc_id, block_id, text, "left", top, "right", bottom FROM blocks')
def a07_blocks(spark, d):
    return ocr.blocks(lines(spark, d)).select("doc_id", F.col("block_id").cast("long").alias("block_id"), "text", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom")])


@query(f"WITH {_RAW}{_LINES} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY line_id)) AS h FROM lines GROUP BY doc_id")
def a08_full_text(spark, d):
    return ocr.full_text(lines(spark, d)).select("doc_id", F.md5(F.col("full_text").cast("binary")).alias("h"))


@query(f"""WITH {_RAW}{_LINES}{_BLOCKS}, r AS (SELECT doc_id, avg(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS nonempty FROM raw GROUP BY doc_id),
w AS (SELECT doc_id, count(*) AS num_words, avg(conf) AS c FROM words GROUP BY doc_id), l AS (SELECT doc_id, count(*) AS num_lines FROM lines GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS num_blocks FROM blocks GROUP BY doc_id)
SELECT doc_id, coalesce(num_words, 0) AS num_words, coalesce(num_lines, 0) AS num_lines, coalesce(num_blocks, 0) AS num_blocks,
  round(0.55 * least(1, greatest(0, coalesce(c, 0) / 100)) + 0.25 * least(1, greatest(0, nonempty)) + 0.20 * least(1, ln(1 + coalesce(num_words, 0)) / ln(201)), 9) AS ocr_quality_score
FROM r LEFT JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN b USING (doc_id)""")
def a09_a10_ocr_stats(spark, d):
    w = words(spark, d)
    li = ocr.lines(w)
    return ocr.stats(raw_words(spark, d), w, li, ocr.blocks(li)).select("doc_id", "num_words", "num_lines", "num_blocks", F.round("ocr_quality_score", 9).alias("ocr_quality_score"))


@query(f"""WITH {_RAW} SELECT doc_id, word_id, list_aggregate(list(text) OVER (PARTITION BY doc_id ORDER BY word_id ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING), 'string_agg', ' ') AS context FROM words""")
def w11_context_windows(spark, d):
    return ocr.context(words(spark, d), 5, 1).select("doc_id", F.col("word_id").cast("long").alias("word_id"), "context")


def _any_sql(anchors) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{a}')" for a in anchors) + ")"


_ZONED = f""",
f AS (SELECT doc_id, line_id, least(1, greatest(0, top / 1400)) AS y, least(1, greatest(0, "left" / 1000)) AS x, {_any_sql(layout.TOTAL_ANCHORS)} AS t, {_any_sql(layout.RECIPIENT_ANCHORS)} AS b,
  {_any_sql((*layout.NUMBER_ANCHORS, "date", "due date", "invoice"))} AS m FROM lines),
g AS (SELECT *, coalesce(min(CASE WHEN b THEN y END) OVER (PARTITION BY doc_id), 0.30) AS by_, coalesce(min(CASE WHEN t THEN y END) OVER (PARTITION BY doc_id), 0.70) AS ty FROM f),
zoned AS (SELECT doc_id, line_id, CASE WHEN t OR y >= ty THEN 'totals' WHEN b OR y >= by_ AND x < 0.55 THEN 'buyer' WHEN m OR y < by_ AND x >= 0.45 THEN 'metadata' WHEN y < by_ AND x < 0.45 THEN 'seller' ELSE 'body' END AS zone FROM g)"""


@query(f"WITH {_RAW}{_LINES}{_ZONED} SELECT doc_id, line_id, zone FROM zoned")
def x05_zones(spark, d):
    return layout.zones(lines(spark, d), F.lit(WIDTH), F.lit(HEIGHT)).select("doc_id", F.col("line_id").cast("long").alias("line_id"), "zone")


@query(f"WITH {_RAW}{_LINES}{_ZONED} SELECT doc_id, " + ", ".join(f"count(*) FILTER (zone = '{z}') AS {z}" for z in ("totals", "buyer", "metadata", "seller", "body")) + " FROM zoned GROUP BY doc_id")
def x06_zone_summary(spark, d):
    return layout.zone_summary(layout.zones(lines(spark, d), F.lit(WIDTH), F.lit(HEIGHT)))


_R = {"top": "norm_top < 0.33", "bottom": "norm_top > 0.66", "left": "norm_left < 0.5", "right": "norm_left >= 0.5", "center": "norm_left >= 0.33 AND norm_left <= 0.66 AND norm_top >= 0.33 AND norm_top <= 0.66", "top_left": "norm_left < 0.5 AND norm_top < 0.5", "top_right": "norm_left >= 0.5 AND norm_top < 0.5", "bottom_left": "norm_left < 0.5 AND norm_top >= 0.5", "bottom_right": "norm_left >= 0.5 AND norm_top >= 0.5"}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {_RAW}, p AS (SELECT doc_id, count(*) AS num_words, round(avg(conf), 6) AS avg_word_confidence, round(quantile_cont(conf, 0.5), 6) AS median_word_confidence, round(avg((conf < 50)::INT), 6) AS low_confidence_word_ratio,
 round(avg(length(text)), 6) AS avg_chars_per_word, {", ".join(f"round(avg(({c})::INT), 6) AS {k}_density" for k, c in _R.items())}, round(least(1, greatest(0, 1 - sum(norm_width * norm_height))), 6) AS blank_space_ratio FROM words GROUP BY doc_id),
b AS (SELECT doc_id, round_even(norm_left * 20, 0) AS bin, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits FROM words GROUP BY ALL),
c AS (SELECT doc_id, count(*) FILTER (digits >= 3) AS numeric_columns, count(*) FILTER (n >= 5) AS repeated_x FROM b GROUP BY doc_id) SELECT * FROM p JOIN c USING (doc_id)""")
def l01_l03_l05_word_features(spark, d):
    return _rounded(layout.word_features(words(spark, d)))


@query(f"""WITH {_RAW}{_LINES}, f AS (SELECT *, length(text) AS n, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS u, length(regexp_replace(text, '[^0-9]', '', 'g')) AS g FROM lines)
SELECT doc_id, count(*) AS num_lines, round(avg(n), 6) AS avg_line_length, round(stddev_pop(n), 6) AS std_line_length, round(avg(width), 6) AS avg_line_width, round(avg(height), 6) AS avg_line_height,
 round(stddev_pop("left"), 6) AS left_std, round(stddev_pop("right"), 6) AS right_std, round(stddev_pop(("left" + "right") / 2), 6) AS center_std, round(avg((n <= 15)::INT), 6) AS short_ratio, round(avg((n >= 80)::INT), 6) AS long_ratio,
 round(avg((u / greatest(n, 1) >= 0.6)::INT), 6) AS upper_ratio, round(avg((g / greatest(n, 1) >= 0.4)::INT), 6) AS numeric_ratio, count(*) FILTER (text LIKE '%:') AS colon_endings,
 count(*) FILTER (regexp_matches(text, '^[A-Za-z][A-Za-z\\s]{{0,30}}:')) AS label_like, round(avg((g / greatest(n, 1) > 0.25)::INT), 6) AS table_like_ratio,
 round(avg(n_words) / (avg(n_words) + stddev_pop(n_words) + 1e-6), 6) AS row_consistency FROM f GROUP BY doc_id""")
def l04_line_features(spark, d):
    return _rounded(layout.line_features(lines(spark, d)))


@query(f"""WITH {_RAW} SELECT doc_id, word_id, CAST(least(1000, greatest(0, round_even("left" * 1000.0 / 1000, 0))) AS INT) AS x0, CAST(least(1000, greatest(0, round_even(top * 1000.0 / 1400, 0))) AS INT) AS y0,
least(1000, greatest(0, CAST(trunc("right" * 1000.0 / 1000) AS INT))) AS x1, least(1000, greatest(0, CAST(trunc(bottom * 1000.0 / 1400) AS INT))) AS y1 FROM words""")
def f15_boxes(spark, d):
    w, h = F.lit(WIDTH), F.lit(HEIGHT)
    return words(spark, d).select("doc_id", F.col("word_id").cast("long").alias("word_id"), N.box_round(F.col("left"), w).alias("x0"), N.box_round(F.col("top"), h).alias("y0"), N.box_floor(F.col("right"), w).alias("x1"), N.box_floor(F.col("bottom"), h).alias("y1"))


@query(f"""WITH {_RAW}, n AS (SELECT *, lead("left") OVER w AS l2, lead(top) OVER w AS t2, lead("right") OVER w AS r2, lead(bottom) OVER w AS b2 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY word_id)),
i AS (SELECT *, greatest(0, least("right", r2) - greatest("left", l2)) * greatest(0, least(bottom, b2) - greatest(top, t2)) AS inter FROM n WHERE l2 IS NOT NULL)
SELECT doc_id, word_id, round(inter / (("right" - "left") * (bottom - top) + (r2 - l2) * (b2 - t2) - inter), 9) AS iou, abs(("left" + "right") / 2 - (l2 + r2) / 2) < 50 AND abs((top + bottom) / 2 - (t2 + b2) / 2) < 50 AS close FROM i""")
def f17_iou_next_word(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("word_id")
    names = ["left", "top", "right", "bottom"]
    df = words(spark, d).withColumns({f"{c}2": F.lead(c).over(w) for c in names}).filter("left2 IS NOT NULL")
    a, b = [F.col(c) for c in names], [F.col(f"{c}2") for c in names]
    return df.select("doc_id", F.col("word_id").cast("long").alias("word_id"), F.round(N.iou(a, b), 9).alias("iou"), N.boxes_close(a, b).alias("close"))


_FLAGS = {
    "numeric": r"regexp_full_match(text, '[0-9]+')",
    "alphabetic": r"regexp_full_match(text, '\p{L}+')",
    "alphanumeric": r"regexp_full_match(text, '[\p{L}\p{N}]+')",
    "uppercase": r"length(text) > 1 AND regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]')",
    "punctuation_heavy": r"length(regexp_replace(text, '[\p{L}\p{N}]', '', 'g')) / length(text) >= 0.3",
    "short": "length(text) <= 2",
    "long": "length(text) >= 12",
    "currency": r"regexp_full_match(text, '[$€£¥₹]?[0-9][0-9,.]*')",
    "date_like": r"regexp_full_match(text, '[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}')",
    "email_like": r"regexp_full_match(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')",
    "url_like": r"regexp_matches(text, '(?i)^(https?://|www\.)')",
    "phone_like": r"regexp_full_match(text, '\+?[0-9][0-9().-]{6,}[0-9]')",
}
_RATIOS, _COUNTS = list(_FLAGS)[:9], ["currency", "date_like", "email_like", "url_like", "phone_like"]


@query(f"WITH {_RAW} SELECT doc_id, " + ", ".join([f"round(avg(({_FLAGS[k]})::INT), 6) AS {k}_token_ratio" for k in _RATIOS] + [f"count(*) FILTER ({_FLAGS[k]})::DOUBLE AS {k}_token_count" for k in _COUNTS]) + " FROM words GROUP BY doc_id")
def l02_token_features(spark, d):
    return _rounded(layout.token_features(words(spark, d)))


@query("SELECT doc_id, image_width, image_height, round(image_width / image_height, 6) AS aspect_ratio, image_width * image_height AS area, CASE WHEN image_height >= image_width THEN 1.0::DOUBLE ELSE 0.0 END AS portrait_vs_landscape_flag FROM (SELECT doc_id, CAST(600 + doc_id % 900 AS DOUBLE) AS image_width, CAST(500 + n_chars % 1300 AS DOUBLE) AS image_height FROM documents)")
def l06_image_features(spark, d):
    return _rounded(layout.image_features(table(spark, d, "documents").select("doc_id", "n_chars"), 600 + F.col("doc_id") % 900, 500 + F.col("n_chars") % 1300).drop("n_chars"))


@query(f"""WITH {_RAW}, w AS (SELECT doc_id, count(*) AS n, avg(conf) AS c FROM words GROUP BY doc_id)
SELECT d.doc_id, 'scan-' || d.doc_id AS file_path, CAST(NULL AS VARCHAR) AS split, d.source AS class_name, CASE WHEN d.doc_id % 5 = 0 OR d.doc_id % 7 <> 3 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN d.doc_id % 5 <> 0 AND d.doc_id % 7 = 3 THEN 'no OCR output' END AS error,
 CASE WHEN d.doc_id % 5 = 0 THEN 11 WHEN d.doc_id % 7 = 3 THEN 0 ELSE coalesce(n, 0) END AS num_words, round(CASE WHEN d.doc_id % 5 = 0 THEN 90 WHEN d.doc_id % 7 = 3 THEN 0 ELSE coalesce(c, 0) END, 6) AS avg_conf, d.doc_id % 5 = 0 AS cache_hit FROM documents d LEFT JOIN w USING (doc_id)""")
def x32_ocr_batch(spark, d):
    """Every fifth document comes from the cache; of the others, those of one remainder of seven have no OCR output."""
    docs = table(spark, d, "documents")
    raw = raw_words(spark, d).filter("doc_id % 7 <> 3")
    metadata = docs.select("doc_id", F.concat(F.lit("scan-"), "doc_id").alias("file_path"), F.col("source").alias("class_name"))
    cache = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit(11).cast("long").alias("num_words"), F.lit(90.0).alias("avg_conf"))
    words = ocr.prepare_words(raw, F.lit(WIDTH), F.lit(HEIGHT))
    return ocr.batch_status(metadata, words, docs.select("doc_id").filter("doc_id % 7 <> 3"), cache).withColumn("avg_conf", F.round("avg_conf", 6))


def _parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All documents, and the words, lines and blocks of those that OCR could read."""
    l = lines(spark, d)  # noqa: E741
    return table(spark, d, "documents"), words(spark, d), l, ocr.blocks(l)


_L01_L05 = f"""WITH {_RAW}{_LINES}{_BLOCKS},
w AS (SELECT doc_id, count(*) AS num_words, count(*) FILTER (trim(text) <> '') AS num_nonempty_words, avg(conf) AS avg_word_confidence, quantile_cont(conf, 0.5) AS median_word_confidence, avg((conf < 50)::INT) AS low_confidence_word_ratio, avg(length(text)) AS avg_chars_per_word,
 least(1, greatest(0, 1 - sum(norm_width * norm_height))) AS blank, count(*) FILTER (length(text) <= 15 AND regexp_matches(text, '^[A-Za-z][A-Za-z\\s]*:?$') AND norm_left < 0.35) AS isolated, avg((norm_top < 0.33)::INT) AS header, avg((norm_top > 0.66)::INT) AS footer FROM words GROUP BY doc_id),
b AS (SELECT doc_id, round_even(norm_left * 20, 0) AS bin, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits FROM words GROUP BY ALL),
c AS (SELECT doc_id, count(*) FILTER (digits >= 3) AS aligned, count(*) FILTER (n >= 5) AS repeated FROM b GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS num_lines, avg(length(text)) AS chars, avg((length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) > 0.25 OR regexp_matches(text, '\\s{{2,}}'))::INT) AS table_like, avg((contains(text, ':'))::INT) AS colons,
 count(*) FILTER (regexp_matches(text, '^[A-Za-z][A-Za-z\\s]{{0,25}}:$')) AS labels, avg(n_words) / (avg(n_words) + stddev_pop(n_words) + 1e-6) AS consistency FROM lines GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS num_blocks FROM blocks GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(num_words, 0) AS num_words, coalesce(num_nonempty_words, 0) AS num_nonempty_words, coalesce(num_lines, 0) AS num_lines, coalesce(num_blocks, 0) AS num_blocks, coalesce(avg_word_confidence, 0) AS avg_word_confidence,
 coalesce(median_word_confidence, 0) AS median_word_confidence, coalesce(low_confidence_word_ratio, 0) AS low_confidence_word_ratio, coalesce(num_words, 0) / greatest(coalesce(num_lines, 0), 1) AS avg_words_per_line, coalesce(avg_chars_per_word, 0) AS avg_chars_per_word, coalesce(chars, 0) AS avg_chars_per_line,
 coalesce(aligned, 0) AS aligned_numeric_column_count_estimate, coalesce(table_like, 0) AS table_like_line_ratio, coalesce(repeated, 0) AS repeated_x_alignment_count, coalesce(colons, 0) AS repeated_colon_label_ratio, coalesce(blank, 1) AS blank_space_ratio_approx, coalesce(labels, 0) AS short_label_count,
 coalesce(isolated, 0) AS isolated_field_like_count, coalesce(consistency, 0) AS row_consistency_score, coalesce(header, 0) AS header_block_prominence, coalesce(footer, 0) AS footer_block_prominence
 FROM (SELECT doc_id FROM documents) LEFT JOIN w USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in (*layout.BASIC, *layout.FORM))} FROM f"""


@query(_L01_L05)
def l01_l05_basic_and_form(spark, d):
    return _rounded(layout.basic_and_form_features(*_parts(spark, d)))


@query()
def l07_feature_table(spark, d):
    """All features of all documents; one remainder of nine could not be read."""
    docs, w, l, b = _parts(spark, d)  # noqa: E741
    return layout.feature_table(docs, w, l, b, docs.filter("doc_id % 9 <> 4"))


@query(f"""WITH {_RAW}, b AS (SELECT doc_id, word_id, CAST(least(1000, greatest(0, round_even("left" * 1000.0 / 1000, 0))) AS INT) AS x0, CAST(least(1000, greatest(0, round_even(top * 1000.0 / 1400, 0))) AS INT) AS y0,
 CAST(least(1000, greatest(0, round_even("right" * 1000.0 / 1000, 0))) AS INT) AS x1, CAST(least(1000, greatest(0, round_even(bottom * 1000.0 / 1400, 0))) AS INT) AS y1, text FROM words),
g AS (SELECT doc_id, string_agg(text || ' ' || x0 || ' ' || y0 || ' ' || CASE WHEN x1 <= x0 THEN least(1000, x0 + 1) ELSE x1 END || ' ' || CASE WHEN y1 <= y0 THEN least(1000, y0 + 1) ELSE y1 END, chr(10) ORDER BY word_id) AS s, count(*) AS n FROM b WHERE word_id < 256 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 1) AS n, md5(coalesce(s, 'empty 0 0 1 1')) AS h FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id)""")
def x29_f15_records(spark, d):
    """Words and boxes of all documents, 256 words at most of each, as the records of a training set."""
    r = records.dataset_records(table(spark, d, "documents").select("doc_id"), words(spark, d), F.lit(WIDTH), F.lit(HEIGHT))
    rows = F.zip_with("words", "boxes", lambda w, b: F.concat_ws(" ", w, F.concat_ws(" ", b.cast("array<string>"))))
    return r.select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join(rows, "\n").cast("binary")).alias("h"))
