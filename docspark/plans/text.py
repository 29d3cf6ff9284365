"""Queries of the text functions, over the whole table of documents; f05_token_flags is limited to words of ASCII signs, f05_all_token_flags is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
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


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents")
def f01_normalized(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("h"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[|\\`~^]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def f02_without_ocr_marks(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.without_ocr_marks(F.col("text")).cast("binary")).alias("h"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[\x00-\x1f\x7f]', ' ', 'g'), '[^a-z0-9\s$€£%.,:;/@#&()+\-]', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([:;/,.\-]){2,}', '\1', 'g'), '\b[a-z]\b', ' ', 'g') AS t FROM a)
SELECT doc_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS h FROM b""")
def f03_baseline_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.baseline_clean(F.col("text")).cast("binary")).alias("h"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS h FROM documents")
def f04_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("h"))


def _count_sql(anchors: list[str]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{a}', ''))) // {len(a)}" for a in anchors)


@query("WITH l AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, " + ", ".join(f"CAST({_count_sql(a)} AS BIGINT) AS n_{c}" for c, a in T.LAYOUT_ANCHORS.items()) + " FROM l")
def f06_anchor_counts(spark, d):
    return _docs(spark, d).select("doc_id", *[T.anchor_count(F.col("text"), a).cast("long").alias(f"n_{c}") for c, a in T.LAYOUT_ANCHORS.items()])


@query(
    r"WITH l AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t || "
    + " || ".join(f"repeat(' anchor_{c}', least(20, {_count_sql(a)}))" for c, a in T.CONFUSION_ANCHORS.items())
    + ") AS h FROM l"
)
def f07_augmented(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.augmented(F.col("text")).cast("binary")).alias("h"))


# What the counters of the router's features count.
COUNTERS = {
    "digits": r"[0-9]",
    "currency": r"[$€£]",
    "percents": r"%",
    "dates": r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    "amounts": r"\b\d{1,3}(,\d{3})*\.\d{2}\b",
    "newlines": r"\n",
    "colons": r":",
    "slashes": r"/",
    "ats": r"@",
    "greetings": r"(?i)\b(dear|hello|hi)\b",
    "signoffs": r"(?i)\b(regards|sincerely|thanks)\b",
    "resume_parts": r"(?i)\b(education|experience|skills|objective|employment)\b",
}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {k}" for k, p in COUNTERS.items()) + " FROM documents")
def f08_regex_counters(spark, d):
    return _docs(spark, d).select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in COUNTERS.items()])


@query(r"""
WITH c AS (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents)
SELECT doc_id, coalesce(chars / nullif(words, 0), 0) AS chars_per_word, coalesce(digits / nullif(chars, 0), 0) AS digit_ratio FROM c""")
def f09_ratios(spark, d):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return _docs(spark, d).select("doc_id", T.safe_div(F.length("text"), words).alias("chars_per_word"), T.safe_div(F.regexp_count("text", F.lit("[0-9]")), F.length("text")).alias("digit_ratio"))


@query(r"""SELECT doc_id, regexp_matches(text, '[$€£]\s?\d+|\b\d{1,3}(,\d{3})*\.\d{2}\b') AS currency,
regexp_matches(text, '\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b') AS date FROM documents""")
def f10_patterns(spark, d):
    return _docs(spark, d).select("doc_id", T.looks_like_currency(F.col("text")).alias("currency"), T.looks_like_date(F.col("text")).alias("date"))


_WORDS = "SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents"


def _words(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w"))


@query(f"WITH w AS ({_WORDS}) SELECT doc_id, count(*) AS total, count(*) FILTER (regexp_matches(w, '^[A-Za-z]{{3,}}:[A-Za-z0-9]') OR length(w) > 8 AND regexp_matches(w, '[a-z][A-Z]')) AS merged FROM w GROUP BY doc_id")
def f11_merged_tokens(spark, d):
    return _words(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(T.is_merged_token(F.col("w"))).alias("merged"))


@query(r"""WITH c AS (SELECT coalesce(len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '^[A-Za-z]{3,}:[A-Za-z0-9]') OR length(w) > 8 AND regexp_matches(w, '[a-z][A-Z]'))), 0) AS m FROM documents)
SELECT CAST(coalesce(sum(m), 0) AS BIGINT) AS total, round(avg(m), 6) AS mean, count(*) FILTER (m >= 1) AS examples FROM c""")
def a24_merged_totals(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    m = F.coalesce(F.size(F.filter(words, T.is_merged_token)), F.lit(0))
    n = F.col("m")
    return _docs(spark, d).select(F.greatest(m, F.lit(0)).alias("m")).agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n >= 1).alias("examples"))


@query("""SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS norm,
regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM customer""")
def f12_comparable(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.letters_and_digits(F.col("c_name")).alias("norm"), T.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


@query("SELECT p_partkey, levenshtein(p_brand, p_type) / length(p_type) AS cer FROM part")
def f13_character_error_rate(spark, d):
    return table(spark, d, "part").select("p_partkey", T.character_error_rate(F.col("p_brand"), F.col("p_type")).alias("cer"))


@query("""SELECT o_orderkey, coalesce(nullif(nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '—' ELSE o_orderstatus END), ''), '—'), nullif(nullif(trim(o_orderpriority), ''), '—')) AS v FROM orders""")
def f22_first_value(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "  ").when(k == 2, T.DASH).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", T.first_value(raw, F.col("o_orderpriority")).alias("v"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN format('{:d} B', n) WHEN n < 1048576 THEN format('{:.1f} KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE format('{:.1f} MB', floor(n / 1048576 * 10 + 0.5) / 10) END AS label FROM (SELECT doc_id, n_chars * 64 AS n FROM documents)")
def f23_size_label(spark, d):
    return _docs(spark, d).select("doc_id", T.size_label(F.col("n_chars") * 64).alias("label"))


@query(f"""WITH w AS ({_WORDS}), f AS (SELECT doc_id,
 regexp_matches(w, '^[0-9]+$') AS numeric, regexp_matches(w, '^[A-Za-z]+$') AS alpha, regexp_matches(w, '^[A-Za-z0-9]+$') AS alnum,
 length(w) > 1 AND upper(w) = w AND lower(w) <> w AS upper_, length(regexp_replace(w, '[A-Za-z0-9_]', '', 'g')) >= 0.3 * length(w) AS punct,
 length(w) <= 2 AS short, length(w) >= 12 AS long_, regexp_matches(w, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') AS email, regexp_matches(w, '(?i)^(https?://|www\\.)') AS url
 FROM w WHERE regexp_matches(w, '^[\\x21-\\x7e]+$'))
SELECT doc_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER ({c}) AS n_{c.strip('_')}" for c in ("numeric", "alpha", "alnum", "upper_", "punct", "short", "long_", "email", "url")) + " FROM f GROUP BY doc_id")
def f05_token_flags(spark, d):
    w = F.col("w")
    flags = {
        "numeric": w.rlike("^[0-9]+$"),
        "alpha": w.rlike("^[A-Za-z]+$"),
        "alnum": w.rlike("^[A-Za-z0-9]+$"),
        "upper": (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w),
        "punct": F.length(F.regexp_replace(w, "[A-Za-z0-9_]", "")) >= 0.3 * F.length(w),
        "short": F.length(w) <= 2,
        "long": F.length(w) >= 12,
        "email": w.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
        "url": w.rlike(r"(?i)^(https?://|www\.)"),
    }
    ascii_words = _words(spark, d).filter(w.rlike(r"^[\x21-\x7e]+$"))
    return ascii_words.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()])


#: Fixed values, as Python's str methods have them: white space, and digits that are no decimals.


@query()
def f05_all_token_flags(spark, d):
    """The twelve flags over every word of every text, in any script. f05_token_flags counts words of ASCII signs only, as its SQL does; DuckDB has no classes that match these."""
    words = _docs(spark, d).select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w")).select("doc_id", "w", T.stripped(F.col("w")).alias("c"))
    return words.groupBy("doc_id").agg(F.count("w").alias("n"), *[F.count_if(x).alias(f"n_{k}") for k, x in T.token_flags(F.col("c")).items()])
