"""Queries of field validators, extraction rules and merging. Candidates are rendered from the keys, dates and names of all orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import fields as V
from docspark.functions.text import DASH
from docspark.operators import evaluation as E
from docspark.operators import layout as L
from docspark.operators import merging as M
from docspark.operators.envelope import answers
from docspark.operators.native import native_fields
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


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """k, and one candidate of each kind."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    variant = k % 6
    fmt = lambda f: F.date_format(day, f)
    dates = F.when(variant == 0, fmt("yyyy-MM-dd")).when(variant == 1, fmt("M/d/yyyy")).when(variant == 2, fmt("d/M/yyyy")).when(variant == 3, fmt("MMMM d, yyyy")).when(variant == 4, fmt("d MMM yyyy")).otherwise(F.format_string("ref %d", k))
    total = F.floor(F.col("o_totalprice"))
    grouped = F.format_number(total, 0)
    amounts = F.when(variant == 0, F.concat(F.lit("$ "), grouped, F.lit(".50"))).when(variant == 1, F.concat(grouped, F.lit(".05 €"))).when(variant == 2, total.cast("string")).when(variant == 3, F.concat(F.lit("£"), k % 900, F.lit(",00"))).when(variant == 4, F.lit("n/a")).otherwise(F.concat(F.lit("| "), k % 900))
    codes = F.when(variant == 0, F.concat(F.lit("INV-"), k)).when(variant == 1, F.format_string("INV%08d", k)).when(variant == 2, (k * 7 + 1000).cast("string")).when(variant == 3, F.lit("INVOICE")).when(variant == 4, F.concat(F.lit("US-"), F.format_string("%03d", k % 1000))).otherwise(F.concat(F.lit("(555) 010-"), F.format_string("%04d", k % 10000)))
    names = F.when(variant == 0, "Alpha Trading Ltd").when(variant == 1, F.concat(F.lit("12 Main Street "), k)).when(variant == 2, "SHIP TO INVOICE # US-001 John Smith").when(variant == 3, "Maria Costa Maria Costa").when(variant == 4, F.lit(DASH)).otherwise(F.concat(F.col("o_clerk_like"), F.lit(" & Sons")))
    return o.withColumn("o_clerk_like", F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")).select(k.alias("k"), day.alias("day"), total.cast("long").alias("total"), dates.alias("d"), amounts.alias("a"), codes.alias("c"), names.alias("n"))


_R = f"""r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS total,
 CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 4 THEN strftime(o_orderdate, '%-d %b %Y') ELSE 'ref ' || o_orderkey END AS d,
 CASE o_orderkey % 6 WHEN 0 THEN '$ ' || format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) || '.50' WHEN 1 THEN format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) || '.05 €' WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 3 THEN '£' || (o_orderkey % 900) || ',00' WHEN 4 THEN 'n/a' ELSE '| ' || (o_orderkey % 900) END AS a,
 CASE o_orderkey % 6 WHEN 0 THEN 'INV-' || o_orderkey WHEN 1 THEN 'INV' || printf('%08d', o_orderkey) WHEN 2 THEN CAST(o_orderkey * 7 + 1000 AS VARCHAR) WHEN 3 THEN 'INVOICE' WHEN 4 THEN 'US-' || printf('%03d', o_orderkey % 1000) ELSE '(555) 010-' || printf('%04d', o_orderkey % 10000) END AS c,
 CASE o_orderkey % 6 WHEN 0 THEN 'Alpha Trading Ltd' WHEN 1 THEN '12 Main Street ' || o_orderkey WHEN 2 THEN 'SHIP TO INVOICE # US-001 John Smith' WHEN 3 THEN 'Maria Costa Maria Costa' WHEN 4 THEN '—' ELSE regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') || ' & Sons' END AS n FROM orders)"""
_CLEAN = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[|\\\\`~^]', ' ', 'g'), '\\s+', ' ', 'g'))"
# what a rendered date must come back as: d/M is read month first where it can be
_ISO = "CASE k % 6 WHEN 5 THEN NULL WHEN 2 THEN CASE WHEN day(day) <= 12 THEN strftime(make_date(year(day), day(day), month(day)), '%Y-%m-%d') ELSE strftime(day, '%Y-%m-%d') END ELSE strftime(day, '%Y-%m-%d') END"


@query(f"WITH {_R} SELECT k, {_ISO} AS iso FROM r")
def v01_v04_dates(spark, d):
    return rendered(spark, d).select("k", V.date(F.col("d")).alias("iso"))


@query(f"""WITH {_R} SELECT k, CASE k % 6 WHEN 0 THEN total || '.50' WHEN 1 THEN total || '.05' WHEN 2 THEN CASE WHEN total BETWEEN 1 AND 999 THEN total || '.00' END WHEN 3 THEN CASE WHEN k % 900 > 0 THEN (k % 900) * 100 || '.00' END WHEN 5 THEN CASE WHEN k % 900 > 0 THEN (k % 900) || '.00' END END AS amount,
CASE k % 6 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 3 THEN CASE WHEN k % 900 > 0 THEN '£' END END AS symbol FROM r""")
def v02_amounts(spark, d):
    x = V.amount(F.col("a"))
    return rendered(spark, d).select("k", x["amount"].alias("amount"), x["symbol"].alias("symbol"))


_PHONE = lambda x: f"(length(regexp_replace({x}, '[^0-9]', '', 'g')) >= 7 AND regexp_matches({x}, '^[+(]?[0-9 .()-]{{7,}}[0-9]$') OR length(regexp_replace({x}, '[^0-9]', '', 'g')) IN (10, 11))"


@query(f"WITH {_R} SELECT k, {_PHONE('c')} AS phone FROM r")
def v03_phones(spark, d):
    return rendered(spark, d).select("k", V.is_phone(F.col("c")).alias("phone"))


@query(f"WITH {_R} SELECT k, CASE WHEN length(c) BETWEEN 2 AND 40 AND NOT {_PHONE('c')} THEN c END AS number, CASE WHEN NOT regexp_matches({_CLEAN('n')}, '(?i)\\b(street|[0-9]{{5}})\\b') AND length(n) >= 2 THEN n END AS name FROM r")
def v05_v06_numbers_and_names(spark, d):
    return rendered(spark, d).select("k", V.invoice_number(F.col("c")).alias("number"), V.name(F.col("n")).alias("name"))


_CANDIDATE = """s AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey % 40 || '-' || o_orderkey % 35 WHEN 2 THEN right('000000' || o_orderkey * 7919 % 1000000, 6)
 WHEN 3 THEN 'INV-' || o_orderkey WHEN 4 THEN (o_orderkey % 120)::VARCHAR WHEN 5 THEN o_orderkey % 12 + 1 || '/' || 1990 + o_orderkey % 50 ELSE (o_orderkey * 104729 % 100000000)::VARCHAR END AS c FROM orders),
n AS (SELECT *, split_part(replace(c, '/', '-'), '-', 1) AS p, split_part(replace(c, '/', '-'), '-', 2) AS q, substr(c, 1, 2) AS a, substr(c, 3, 2) AS b, substr(c, 5, 2) AS e FROM s),
y AS (SELECT k, c, CASE WHEN regexp_matches(c, '^[0-9]{1,4}$') THEN c::INT > 0
 WHEN regexp_matches(c, '^[0-9]{6}$') THEN CASE WHEN a > '31' THEN try_cast('20' || a || '-' || b || '-' || e AS DATE) WHEN a > '12' THEN try_cast('20' || e || '-' || b || '-' || a AS DATE) ELSE try_cast('20' || e || '-' || a || '-' || b AS DATE) END IS NOT NULL
 WHEN regexp_matches(c, '^[0-9]+[/-][0-9]+$') THEN CASE WHEN p::INT > 31 THEN q::INT BETWEEN 1 AND 12 WHEN q::INT > 31 THEN p::INT BETWEEN 1 AND 12 ELSE try_cast('2000-' || p || '-' || q AS DATE) IS NOT NULL END
 ELSE false END AS date_like FROM n)"""


@query(f"WITH {_CANDIDATE} SELECT k, date_like, CASE WHEN length(c) >= 2 AND NOT date_like AND NOT {_PHONE('c')} THEN c END AS number FROM y")
def v04_v05_strict(spark, d):
    """Numbers of orders as keys, pairs, six digits, years and long numbers: which are dates in part, and which are left as invoice numbers."""
    k = F.col("o_orderkey")
    t = lambda x: x.cast("string")
    shapes = [t(k), F.concat(t(k % 40), F.lit("-"), t(k % 35)), F.lpad(t(k * 7919 % 1_000_000), 6, "0"), F.concat(F.lit("INV-"), t(k)), t(k % 120), F.concat(t(k % 12 + 1), F.lit("/"), t(1990 + k % 50)), t(k * 104729 % 100_000_000)]
    c = F.element_at(F.array(*shapes), (k % 7 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("k"), V.is_date_like(c).alias("date_like"), V.invoice_number(c, strict_compat=True).alias("number"))


@query("SELECT c_custkey, c_nationkey % 2 = 1 AS differ FROM customer")
def v07_differ(spark, d):
    c = table(spark, d, "customer")
    other = F.when(F.col("c_nationkey") % 2 == 0, F.upper(F.regexp_replace("c_name", "#", " - "))).otherwise(F.concat("c_name", F.lit("x")))
    return c.select("c_custkey", V.differ(F.col("c_name"), other).alias("differ"))


@query("""SELECT o_orderkey, round((CASE WHEN o_orderkey % 2 = 0 THEN 0.2 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 0.2 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 0.1 ELSE 0 END) + 0.2 + (CASE WHEN o_orderkey % 7 = 0 THEN 0.1 ELSE 0 END), 3) AS score FROM orders""")
def v08_confidence(spark, d):
    k = F.col("o_orderkey")
    given = lambda m: F.when(k % m == 0, "x")
    f = {"invoice_number": given(2), "invoice_date": given(3), "due_date": given(5), "issuer_name": F.lit("x"), "recipient_name": F.lit(" "), "total_amount": given(7)}
    return table(spark, d, "orders").select("o_orderkey", V.confidence(f).alias("score"))


@query(f"WITH {_R} SELECT k, CASE WHEN k % 6 = 5 THEN '' ELSE d END AS dates, CASE k % 6 WHEN 0 THEN '$ ' || format('{{:,}}', total) || '.50' WHEN 1 THEN format('{{:,}}', total) || '.05' || (CASE WHEN total < 1000 THEN ' €' ELSE '' END) WHEN 2 THEN CASE WHEN total >= 1000 THEN total::VARCHAR ELSE '' END WHEN 3 THEN '£' || (k % 900) ELSE '' END AS amounts FROM r")
def v09_dates_and_amounts_in_text(spark, d):
    r = rendered(spark, d)
    return r.select("k", F.array_join(V.dates_in(F.concat(F.lit("dated "), "d", F.lit(" by us"))), "|").alias("dates"), F.array_join(V.amounts_in(F.concat(F.lit("sum "), "a")), "|").alias("amounts"))


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{a}')" for a in L.TOTAL_ANCHORS) + " THEN true ELSE false END AS total, contains(lower(text), 'from') AS sender FROM documents")
def v10_anchor_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", L.has_any(F.col("text"), L.TOTAL_ANCHORS).alias("total"), L.has_any(F.col("text"), ["from"]).alias("sender"))


@query(f"WITH {_R} SELECT k, CASE k % 3 WHEN 0 THEN trim(n) WHEN 1 THEN c END AS value FROM r")
def v11_after_anchor(spark, d):
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Bill To: "), "n")).when(F.col("k") % 3 == 1, F.concat(F.lit("SOLD TO #\t"), "c")).otherwise(F.lit("Client:  "))
    return rendered(spark, d).select("k", V.after_anchor(line, L.RECIPIENT_ANCHORS).alias("value"))


@query(f"WITH {_R} SELECT k, CASE WHEN k % 4 <> 3 THEN strftime(day + CAST(k % 4 * 15 AS INTEGER), '%Y-%m-%d') END AS due, k % 4 <> 3 AS inferred FROM r")
def v12_due_from_terms(spark, d):
    terms = F.when(F.col("k") % 4 != 3, F.concat(F.lit("Terms: Net "), F.col("k") % 4 * 15)).otherwise(F.lit("on receipt"))
    x = V.due_from_terms(F.date_format("day", "yyyy-MM-dd"), terms)
    return rendered(spark, d).select("k", x["due"].alias("due"), x["inferred"].alias("inferred"))


@query(f"WITH {_R} SELECT k, CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 99 WHEN 4 THEN 0 ELSE 4 END AS rank FROM r")
def v13_v14_number_rank(spark, d):
    return rendered(spark, d).select("k", V.number_rank(V.candidate(F.concat(F.lit("("), F.regexp_replace("c", r"^\(", ""), F.lit("),"))), F.lit(True)).alias("rank"))


@query(f"WITH {_R} SELECT k, k % 6 IN (1, 2, 4) OR n = ' & Sons' OR length(regexp_replace(n, '[^A-Za-z]', '', 'g')) / length(n) < 0.4 AS garbage, k % 6 IN (1, 2) AS noisy FROM r")
def v15_v16_garbage_and_noise(spark, d):
    return rendered(spark, d).select("k", V.is_issuer_garbage(F.col("n")).alias("garbage"), V.is_noisy(F.col("n")).alias("noisy"))


@query(f"WITH {_R} SELECT k, CASE k % 6 WHEN 3 THEN 'Maria Costa' ELSE n END AS once, CASE k % 6 WHEN 2 THEN 'John Smith' WHEN 3 THEN 'Maria Costa Maria Costa' WHEN 0 THEN 'Alpha Trading Ltd' WHEN 1 THEN '12 Main ' || k WHEN 4 THEN '' ELSE n END AS cleaned FROM r")
def v17_clean_names(spark, d):
    return rendered(spark, d).select("k", V.once(F.col("n")).alias("once"), V.without_noise(F.col("n")).alias("cleaned"))


@query(f"WITH {_R} SELECT k, CASE WHEN k % 2 = 0 THEN '$' || total || '.50' ELSE total || '.75' END AS kept, '£' || total || '.00' AS decimal FROM r")
def v18_v19_v20_symbols(spark, d):
    two = F.when(F.col("k") % 2 == 0, F.concat("total", F.lit(".50"))).otherwise(F.concat("total", F.lit(".75")))
    one = F.concat(F.lit("$"), "total", F.lit(".50"))
    return rendered(spark, d).select("k", V.keep_symbol(two, two, one).alias("kept"), V.decimal_point(F.concat(F.lit("£"), "total", F.lit(",00"))).alias("decimal"))


def extractions(spark, d) -> DataFrame:
    """doc_id, source and the six fields, for three sources; some values are missing or noisy."""
    r = rendered(spark, d)
    k = F.col("k")

    def one(source: str, i: int) -> DataFrame:
        gap = lambda m, x: F.when((k + i) % m == 0, F.lit("")).when((k + i) % (m + 2) == 0, F.lit(DASH)).otherwise(x)
        return r.select(k.alias("doc_id"), F.lit(source).alias("source"), gap(3, F.concat(F.col("c"), F.lit(f"/{i}"))).alias("invoice_number"), gap(4, F.col("d")).alias("invoice_date"), gap(2, F.lit(f"2024-0{i + 1}-01")).alias("due_date"), gap(5, F.concat(F.lit("Issuer "), F.lit("ABC"[i]))).alias("issuer_name"), gap(3, F.concat(F.lit("Person "), F.lit("xyz"[i]))).alias("recipient_name"), gap(4, F.concat("total", F.lit(f".0{i}"))).alias("total_amount"))

    return one("baseline", 0).unionByName(one("improved", 1)).unionByName(one("two_stage", 2))


def _ex_sql() -> str:
    def one(source: str, i: int) -> str:
        gap = lambda m, x: f"CASE WHEN (k + {i}) % {m} = 0 THEN '' WHEN (k + {i}) % {m + 2} = 0 THEN '—' ELSE {x} END"
        return f"""SELECT k AS doc_id, '{source}' AS source, {gap(3, f"c || '/{i}'")} AS invoice_number, {gap(4, "d")} AS invoice_date, {gap(2, f"'2024-0{i + 1}-01'")} AS due_date, {gap(5, f"'Issuer {'ABC'[i]}'")} AS issuer_name, {gap(3, f"'Person {'xyz'[i]}'")} AS recipient_name, {gap(4, f"total || '.0{i}'")} AS total_amount FROM r"""

    return " UNION ALL ".join([one("baseline", 0), one("improved", 1), one("two_stage", 2)])


_EX = f"{_R}, ex AS ({_ex_sql()})"
_SIDE = f"""{_EX}, s AS (SELECT b.doc_id, {", ".join(f"{a}.{f} AS {a}_{f}" for a in ("b", "i", "t") for f in E.FIELDS)} FROM (SELECT * FROM ex WHERE source = 'baseline') b JOIN (SELECT * FROM ex WHERE source = 'improved') i USING (doc_id) JOIN (SELECT * FROM ex WHERE source = 'two_stage') t USING (doc_id))"""
_FIRST = lambda *xs: "coalesce(" + ", ".join(f"nullif(nullif({x}, ''), '—')" for x in xs[:-1]) + f", {xs[-1]})"
_SHORT = {"two_stage": "t", "improved": "i", "baseline": "b"}


def _source(f: str) -> str:
    p = M.PRIORITY[f]
    return f"CASE WHEN {_SHORT[p[0]]}_{f} NOT IN ('', '—') THEN '{p[0]}' WHEN {_SHORT[p[1]]}_{f} NOT IN ('', '—') THEN '{p[1]}' ELSE '{p[2]}' END"


@query(f"WITH {_SIDE} SELECT doc_id, " + ", ".join(f"{_FIRST(*[f'{_SHORT[s]}_{f}' for s in M.PRIORITY[f]])} AS {f}, {_source(f)} AS source_{f}" for f in E.FIELDS) + " FROM s")
def x23_j09_merge_three(spark, d):
    return M.merge_three(M.side_by_side(extractions(spark, d), ["baseline", "improved", "two_stage"]))


@query(f"""WITH {_SIDE} SELECT doc_id, {_FIRST("t_invoice_number", "i_invoice_number")} AS invoice_number, i_invoice_date AS invoice_date, i_due_date AS due_date, {_FIRST("t_issuer_name", "i_issuer_name")} AS issuer_name, i_recipient_name AS recipient_name,
 CASE WHEN {_FIRST("t_total_amount", "i_total_amount")} = '—' THEN '' ELSE {_FIRST("t_total_amount", "i_total_amount")} END AS total_amount FROM s""")
def x20_merge_hybrid(spark, d):
    return M.merge_hybrid(M.side_by_side(extractions(spark, d), ["improved", "two_stage"]))


@query(f"""WITH {_SIDE} SELECT doc_id, {_FIRST("i_invoice_number", "b_invoice_number")} AS invoice_number, {_FIRST("i_invoice_date", "b_invoice_date")} AS invoice_date, {_FIRST("i_due_date", "b_due_date")} AS due_date, {_FIRST("b_issuer_name", "i_issuer_name")} AS issuer_name,
 {_FIRST("b_recipient_name", "i_recipient_name")} AS recipient_name, {_FIRST("i_total_amount", "b_total_amount")} AS total_amount, false AS swap_suspected FROM s""")
def x22_merge_two(spark, d):
    return M.merge_two(M.side_by_side(extractions(spark, d), ["baseline", "improved"]), F.array(F.lit("INV15261847")))


@query(f"WITH {_EX} SELECT doc_id, field, value FROM (UNPIVOT (SELECT doc_id, {', '.join(E.FIELDS)} FROM ex WHERE source = 'improved') ON {', '.join(E.FIELDS)} INTO NAME field VALUE value) WHERE value NOT IN ('', '—')")
def k10_p16_export_rows(spark, d):
    return M.export_rows(extractions(spark, d).filter("source = 'improved'").drop("source"))


@query(f"WITH {_EX} SELECT field, round_even(100 * avg((trim(value) <> '')::INT), 1) AS rate FROM (UNPIVOT (SELECT doc_id, {', '.join(E.FIELDS)} FROM ex WHERE source = 'improved') ON {', '.join(E.FIELDS)} INTO NAME field VALUE value) GROUP BY field")
def a19_field_rates(spark, d):
    return E.field_rates(extractions(spark, d).filter("source = 'improved'"))


_NA = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH {_SIDE}, u AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, {_NA(f'i_{f}')} AS p, {_NA(f't_{f}')} AS t FROM s" for f in E.FIELDS)})
SELECT field, round_even(100 * avg((p = t)::INT), 1) AS exact, round_even(100 * avg((p <> '' AND (contains(t, p) OR contains(p, t)))::INT), 1) AS partial, count(*) AS n FROM u WHERE t <> '' GROUP BY field""")
def a21_match_rates(spark, d):
    s = M.side_by_side(extractions(spark, d), ["improved", "two_stage"])
    return E.match_rates(s.select("doc_id", *[F.col("improved")[f].alias(f"predicted_{f}") for f in E.FIELDS], *[F.col("two_stage")[f].alias(f"true_{f}") for f in E.FIELDS]))


@query()
def x18_native_fields(spark, d):
    """Fields of native pages over all orders: lines of number, dates, recipient and total in eight layouts, with names of customers and suppliers."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    iso, dotted, words = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "MMMM d, yyyy")
    due, total = F.date_format(F.date_add(day, 30), "yyyy-MM-dd"), F.format_number("o_totalprice", 2)
    lines = lambda *xs: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    shop = F.concat(F.lit("Shop "), k % 97)
    pages = [
        lines(shop, F.concat(F.lit("Invoice No: INV-"), k), F.concat(F.lit("Date: "), iso), "Bill To:", F.col("c_name"), F.concat(F.lit("Grand Total: $"), total)),
        lines(F.concat(F.lit("INVOICE # A-"), k), F.concat(F.lit("issued "), words), F.concat(F.lit("Payment due: "), due), "billed to", F.col("c_name"), F.concat(F.lit("Total ** "), total, F.lit(" EUR"))),
        lines("Date", "To", "Ship To", iso, F.col("c_name"), F.concat(F.lit("Amount due: "), total, F.lit(" £"))),
        lines("Order Date", "Order Number", "Due Date", iso, F.concat(F.lit("N"), k), due, F.concat(F.lit("Balance due "), total)),
        lines(shop, F.concat(F.lit("INVOICE "), 10000 + k), dotted, "invoice", F.concat(F.lit("Total due: "), k % 60, F.lit(".09"))),
        lines(F.concat(F.lit("+49 30 "), 1000000 + k), shop, "Ship to", F.col("c_name"), F.concat(F.lit("Total due by "), due), total),
        lines(F.concat(k, F.lit(" Main Street")), "Invoice number: none", F.concat(F.lit("payable by "), due), F.concat(F.lit("Total due 0."), k % 10)),
        lines(shop, F.concat(F.lit("Due date: "), iso), F.concat(F.lit("Date "), iso), "To", F.col("c_name")),
    ]
    page = F.element_at(F.array(*pages), (k % 8 + 1).cast("int"))
    return native_fields(o.join(c, "o_custkey", "left").select(k.alias("k"), page.alias("text"))).drop("text")


_ENDING = "['.pdf', '.png', '.PDF', '.txt', '.jpg', '.webp'][doc_id % 6 + 1]"
_UPLOADS = f"""u AS (SELECT 'd' || doc_id || {_ENDING} AS filename, lower({_ENDING}) AS ending, strlen(text) AS size, lang IS NOT NULL AS ready, length(text) >= 100 AS long, doc_id % 7 <> 3 AS readable, doc_id % 11 <> 5 AS told, doc_id % 3 = 0 AS invoice, doc_id % 5 <> 2 AS hybrid, doc_id % 4 <> 1 AS fallback FROM documents
 UNION ALL SELECT 'c' || conv_id || '-' || turn || '.png', '.png', strlen(text), true, false, conv_id % 7 <> 3, conv_id % 11 <> 5, role = 'user', turn % 2 = 0, turn % 3 <> 1 FROM conversations),
s AS (SELECT *, CASE WHEN ending = '.txt' THEN 400 WHEN NOT ready THEN 503 WHEN coalesce(size, 0) = 0 THEN 400 WHEN ending = '.pdf' AND long THEN 200 WHEN NOT readable THEN 422 WHEN NOT told OR invoice AND NOT hybrid AND NOT fallback THEN 500 ELSE 200 END AS status FROM u)"""


@query(f"""WITH {_UPLOADS} SELECT filename, status, CASE WHEN status = 200 THEN CASE WHEN ending = '.pdf' AND long THEN 'native_pdf_text' WHEN NOT invoice THEN 'classified' WHEN hybrid THEN 'hybrid' ELSE 'one_stage_fallback' END END AS mode,
 status = 200 AND (ending = '.pdf' AND long OR invoice) AS is_invoice, status <> 200 OR NOT (ending = '.pdf' AND long) AND invoice AND NOT hybrid AS has_error,
 status = 200 AND NOT (ending = '.pdf' AND long) AND invoice AS has_model_fields FROM s""")
def s13_x28_x30_answers(spark, d):
    """Answers to uploads: all documents, with endings, missing models and failures by their ids, and all turns of conversations as images."""
    m = F.create_map(F.lit("total_amount"), F.lit("1"))
    kind = "struct<filename:string,size:long,readable:boolean,pages:array<string>,models_ready:boolean,pred_label:string,confidence:double,hybrid:map<string,string>,one_stage:map<string,string>>"

    def uploads(df: DataFrame, name, pages, ready, key, invoice, hybrid, fallback) -> DataFrame:
        label = F.when(key % 11 != 5, F.when(invoice, "invoice").otherwise("form"))
        row = F.struct(name, F.octet_length("text"), key % 7 != 3, pages, ready, label, F.lit(0.5), F.when(hybrid, m), F.when(fallback, m))
        return df.select(row.cast(kind).alias("u")).select("u.*")

    i, c, t = F.col("doc_id"), F.col("conv_id"), F.col("turn")
    ends = F.element_at(F.array(*map(F.lit, [".pdf", ".png", ".PDF", ".txt", ".jpg", ".webp"])), (i % 6 + 1).cast("int"))
    first = uploads(table(spark, d, "documents"), F.concat(F.lit("d"), i, ends), F.array("text"), F.col("lang").isNotNull(), i, i % 3 == 0, i % 5 != 2, i % 4 != 1)
    second = uploads(table(spark, d, "conversations"), F.concat(F.lit("c"), c, F.lit("-"), t, F.lit(".png")), F.lit(None), F.lit(True), c, F.col("role") == "user", t % 2 == 0, t % 3 != 1)
    out = answers(first.unionByName(second))
    return out.select("filename", F.col("status").cast("int").alias("status"), "mode", "is_invoice", F.col("error").isNotNull().alias("has_error"), F.coalesce(F.col("mode").isin("hybrid", "one_stage_fallback") & F.col("fields").isNotNull(), F.lit(False)).alias("has_model_fields"))
