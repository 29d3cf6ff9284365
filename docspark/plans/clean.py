"""Queries of the cleaners. Raw values are rendered from the keys of all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import cleaning as C
from docspark.operators import corrections as K
from docspark.plans.extract import _R, rendered
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


@query(f"WITH {_R} SELECT k, CASE k % 6 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d ELSE '' END AS date FROM r")
def x08_clean_dates(spark, d):
    return rendered(spark, d).select("k", C.date(F.concat(F.lit("on "), "d", F.lit(" ok"))).alias("date"))


@query(f"WITH {_R} SELECT k, CASE k % 3 WHEN 0 THEN total || '.25 USD' WHEN 1 THEN '$' || total || '.50' ELSE total || '.75 EUR' END AS amount FROM r")
def x09_clean_amounts(spark, d):
    k = F.col("k")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Total: usd "), "total", F.lit(".25"))).when(k % 3 == 1, F.concat(F.lit("due $ "), "total", F.lit(".50 now"))).otherwise(F.concat("total", F.lit(".75 EUR")))
    return rendered(spark, d).select("k", C.amount(raw).alias("amount"))


@query(f"WITH {_R} SELECT k, CASE k % 3 WHEN 0 THEN 'INV-' || k WHEN 1 THEN 'a1' ELSE 'none' END AS number FROM r")
def x10_clean_numbers(spark, d):
    k = F.col("k")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Invoice No: (INV-"), k, F.lit(") of"))).when(k % 3 == 1, F.lit("Ref a1 x")).otherwise(F.lit("value is none"))
    return rendered(spark, d).select("k", C.invoice_number(raw).alias("number"))


@query(f"WITH {_R} SELECT k, CASE k % 4 WHEN 0 THEN 'Acme Works' WHEN 1 THEN 'John' WHEN 2 THEN 'A B C D E F' ELSE '' END AS name FROM r")
def x11_clean_names(spark, d):
    k = F.col("k")
    raw = F.when(k % 4 == 0, F.concat(F.lit("Bill To: Acme Works, "), k + 10, F.lit(" Elm"))).when(k % 4 == 1, F.lit("from John Steven")).when(k % 4 == 2, F.lit("A B C D E F G H")).otherwise(F.lit("Attn: me@x.org"))
    return rendered(spark, d).select("k", C.name(raw).alias("name"))


@query(f"WITH {_R} SELECT k, c AS invoice_number, CAST(total AS VARCHAR) AS total_amount FROM r")
def x27_tag_round_trip(spark, d):
    t = C.tagged({"invoice_number": F.col("c"), "total_amount": F.col("total").cast("string")})
    return rendered(spark, d).withColumn("t", t).select("k", C.untagged(F.col("t"), "invoice_number").alias("invoice_number"), C.untagged(F.col("t"), "total_amount").alias("total_amount"))


def _noted(spark, d):
    """doc_id, the words of each whole text behind a line of labels and values that varies with the id, and the fields that were read."""
    i = F.col("doc_id")
    day = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % n).cast("int")), "yyyy-MM-dd")
    line = (
        F.when(i % 6 == 0, F.concat(F.lit("Invoice date: "), day(300), F.lit(" x x x x Payment due "), day(200)))
        .when(i % 6 == 1, F.concat(F.lit("Due: "), day(100), F.lit(" Total: $ "), i, F.lit(".50")))
        .when(i % 6 == 2, F.concat(F.lit("issued "), day(77), F.lit(" Invoice No: INV-"), i))
        .when(i % 6 == 3, F.concat(day(50), F.lit(" and "), day(60)))
        .otherwise(F.lit("no labels"))
    )
    words = F.split(F.concat_ws(" ", line, F.coalesce("text", F.lit(""))), r"\s+")
    return table(spark, d, "documents").select(
        "doc_id",
        words.alias("words"),
        F.when(i % 3 == 0, day(200)).otherwise("").alias("invoice_date"),
        F.when(i % 6 == 0, day(200)).when(i % 5 == 1, "9-3/22").otherwise("").alias("due_date"),
        F.when(i % 2 == 0, F.concat(F.lit("INV-"), i)).otherwise("TO").alias("invoice_number"),
        F.when(i % 7 == 0, "Acme Ltd info@acme.test").otherwise("Acme Ltd").alias("issuer_name"),
        F.lit("Bo Lee").alias("recipient_name"),
        F.when(i % 5 == 0, "24.09").when(i % 5 == 1, "").otherwise("$ 90.00").alias("total_amount"),
    )


@query()
def x14_x15_dates(spark, d):
    return K.arbitrate_dates(K.fallback_dates(_noted(spark, d))).select("doc_id", "invoice_date", "due_date")


@query()
def x17_validate_and_correct(spark, d):
    return K.validate_and_correct(_noted(spark, d)).drop("words")


@query(
    "SELECT o_orderkey AS k, "
    + ", ".join(f"CASE WHEN (o_orderkey * 7 + {i * 13}) % 101 >= {round(100 * t)} THEN '{f}' || o_orderkey ELSE '' END AS {f}, round((o_orderkey * 7 + {i * 13}) % 101 / 100.0::DOUBLE, 4) AS {f}_conf" for i, (f, t) in enumerate(K.THRESHOLDS.items()))
    + " FROM orders"
)
def p07_j08_gate(spark, d):
    k = F.col("o_orderkey")
    given = [c for i, f in enumerate(K.THRESHOLDS) for c in (F.concat(F.lit(f), k).alias(f), ((k * 7 + i * 13) % 101 / F.lit(100.0)).alias(f"{f}_conf"))]
    return K.gate(table(spark, d, "orders").select(k.alias("k"), *given))
