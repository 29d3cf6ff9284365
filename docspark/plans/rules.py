"""Queries of the rule extractor and the cleaner's driver. Every order is rendered as the lines of an invoice, with labels and values in varying places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import corrections as K
from docspark.operators import layout
from docspark.operators import rules as R
from docspark.plans.clean import _noted
from docspark.session import table

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


def invoice_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id (an order's key), line_id, top, left, text, zone: eleven lines an invoice."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kind = F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")
    total = F.format_number(F.floor("o_totalprice"), 0)
    iso, v, r, t = F.date_format(day, "yyyy-MM-dd"), k % 4, F.floor(k / 2) % 3, F.floor(k / 3) % 3
    texts = [
        (20, 50, F.concat(F.lit("Alpha "), kind, F.lit(" Ltd"))),
        (60, 600, F.when(v == 0, F.concat(F.lit("Invoice No: INV-"), k)).when(v == 1, F.lit("Invoice #")).when(v == 2, F.concat(F.lit("Code ABC-"), k + 1000)).otherwise(F.concat(F.lit("Ref No INV/2024-"), k))),
        (100, 600, F.when(v == 1, F.concat(F.lit("A-"), k)).otherwise(F.lit("Page one"))),
        (140, 600, F.when(k % 3 == 0, F.concat(F.lit("Invoice Date: "), iso)).when(k % 3 == 1, F.lit("Date:")).otherwise(F.concat(F.lit("on "), iso))),
        (180, 600, F.when(k % 3 == 1, F.date_format(day, "d MMM yyyy")).otherwise(F.lit("Currency note"))),
        (440, 50, F.when(r == 0, F.concat(F.lit("Bill To: Berta "), kind)).when(r == 1, F.lit("Bill To")).otherwise(F.concat(F.lit("Berta "), kind))),
        (460, 50, F.when(r == 1, F.concat(F.lit("Berta "), kind)).otherwise(F.lit("Thanks"))),
        (480, 600, F.when(k % 2 == 0, F.concat(F.lit("Payment due by "), F.date_format(F.date_add(day, 30), "yyyy-MM-dd"))).otherwise(F.lit("Terms: Net 15"))),
        (1000, 50, F.lit("Subtotal $ 1.00")),
        (1040, 50, F.when(t == 0, F.concat(F.lit("Grand Total: $ "), total, F.lit(".50"))).when(t == 1, F.lit("Total")).otherwise(F.lit("Carried over"))),
        (1080, 50, F.concat(total, F.lit(".05 €"))),
    ]
    lines = F.array(*[F.struct(F.lit(i).alias("line_id"), F.lit(y).alias("top"), F.lit(x).alias("left"), text.alias("text")) for i, (y, x, text) in enumerate(texts)])
    return layout.zones(o.select(k.alias("doc_id"), F.inline(lines)), F.lit(WIDTH), F.lit(HEIGHT))


_FIELDS = """o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'INV-' || o_orderkey WHEN 1 THEN 'A-' || o_orderkey WHEN 2 THEN 'ABC-' || (o_orderkey + 1000) ELSE 'INV/2024-' || o_orderkey END AS invoice_number,
strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS invoice_date, strftime(CAST(o_orderdate AS DATE) + CASE o_orderkey % 2 WHEN 0 THEN 30 ELSE 0 END, '%Y-%m-%d') AS due_date, 'Alpha ' || regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') || ' Ltd' AS issuer_name,
'Berta ' || regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') AS recipient_name, CAST(floor(o_totalprice) AS BIGINT) || CASE o_orderkey // 3 % 3 WHEN 0 THEN '.50' ELSE '.05' END AS total_amount, false AS due_date_inferred,
CASE WHEN o_orderkey // 3 % 3 = 0 THEN '$' WHEN floor(o_totalprice) < 1000 THEN '€' END AS currency_symbol, CAST(1.0 AS DOUBLE) AS extraction_confidence"""


@query(f"SELECT {_FIELDS} FROM orders")
def x07_rule_fields(spark, d):
    return R.extract_fields(invoice_lines(spark, d))


@query(f"SELECT {_FIELDS}, NULL::VARCHAR AS error FROM orders UNION ALL SELECT -1 - s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, 0.0, 'no lines' FROM supplier")
def x24_rule_batch(spark, d):
    """All orders, and documents without lines (named by suppliers)."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).unionByName(table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("doc_id")))
    return R.extract_batch(asked, invoice_lines(spark, d))


@query("SELECT o_orderkey AS doc_id, generate_series AS rank, CASE generate_series WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS line_id FROM orders, generate_series(1, 3)")
def w03_top_lines(spark, d):
    """The three highest lines of each invoice."""
    pages = invoice_lines(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("line_id", "top")).alias("lines"))
    return pages.select("doc_id", F.posexplode(R.top_lines(F.col("lines"), 3)).alias("rank", "line")).select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "line.line_id")


@query()
def x12_x13_cleaned(spark, d):
    """The cleaner over whole texts: fields cleaned, recipient and dates from the words."""
    raw = _noted(spark, d).withColumn("recipient_name", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("recipient_name")))
    words = F.when(F.col("doc_id") % 2 == 0, F.concat(F.array(F.lit("Bill"), F.lit("to:"), F.lit("Nina"), F.lit("Costa,"), F.concat(F.lit("12"), F.col("doc_id"))), F.col("words"))).otherwise(F.col("words"))
    return K.clean_fields(raw.withColumn("words", words)).drop("words")
