"""The rule extractor on pages made by hand, and the recipient from the words against a plain version."""

import random
import re

import pytest
from docspark.operators import corrections as C
from docspark.operators import layout as L
from docspark.operators import rules as R
from docspark.operators.cleaning import ADDRESS_WORDS
from pyspark.sql import functions as F

LINES = "doc_id string, line_id int, top int, left int, text string"


PAGES = {
    "first of equal totals": [(700, 0, "Total: $ 10.00"), (720, 0, "Amount due $ 20.00"), (740, 0, "Balance due $ 30.00"), (760, 0, "Tax total $ 99.00")],
    "label line before next line": [(700, 0, "Total"), (720, 0, "$ 5.00"), (740, 0, "Total $ 7.00")],
    "first next line": [(700, 0, "Total"), (720, 0, "$ 5.00"), (740, 0, "Grand total"), (760, 0, "$ 8.00")],
    "largest of the zone": [(10, 0, "Acme Works"), (800, 0, "$ 5.00"), (820, 0, "$ 50.00"), (840, 0, "$ 7.00")],
    "equal names": [(10, 0, "Acme Works"), (400, 0, "Bill to: ACME works")],
    "behind labels": [(10, 0, "From: Acme Works"), (400, 0, "Bill to"), (420, 0, "12 Main Street"), (440, 0, "Bo Lee")],
    "any date is due": [(10, 0, "Acme Works"), (100, 600, "Invoice date 2024-02-03"), (120, 0, "Net 30")],
}


def test_pages(spark):
    rows = [(k, i, y, x, t) for k, lines in PAGES.items() for i, (y, x, t) in enumerate(lines)]
    got = {r["doc_id"]: r for r in R.extract_fields(L.zones(spark.createDataFrame(rows, LINES), F.lit(1000), F.lit(1000))).collect()}
    assert {k: got[k]["total_amount"] for k in list(PAGES)[:4]} == {"first of equal totals": "20.00", "label line before next line": "7.00", "first next line": "5.00", "largest of the zone": "50.00"}
    r = got["equal names"]
    assert (r["issuer_name"], r["recipient_name"], r["extraction_confidence"]) == ("Acme Works", None, 0.2)
    assert (got["behind labels"]["issuer_name"], got["behind labels"]["recipient_name"]) == ("Acme Works", "Bo Lee")
    r = got["any date is due"]
    assert (r["invoice_date"], r["due_date"], r["due_date_inferred"]) == ("2024-02-03", "2024-02-03", False)


def test_codes_with_as_many_digits_as_a_telephone(spark):
    from docspark.functions import fields as V

    cases = {"INV/2024-100003": True, "INV/2024-1234567": True, "A1234567890": True, "2024-100003": False, "5550100001": False, "(555) 010-0001": False, "Tel-555-010-0001": False, "Phone 555 010 0001": False}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: (r.n is not None, r.s is not None) for r in df.select("c", V.invoice_number(F.col("c")).alias("n"), V.invoice_number(F.col("c"), strict_compat=True).alias("s")).collect()}
    assert got == {c: (ok, False) for c, ok in cases.items()}


@pytest.mark.parametrize("name", ["x07_rule_fields", "x24_rule_batch"])
def test_queries_on_large_keys(spark, tmp_path, name):
    import duckdb
    from docspark.plans import rules as P

    orders = spark.range(99_990, 100_020).unionByName(spark.range(8_999_980, 9_000_000)).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.col("id") * 86400 % 900_000_000).alias("o_orderdate"), (1001.0 + F.col("id") % 400_000).alias("o_totalprice"), F.lit("4-NOT SPECIFIED").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, cur = P.QUERIES[name](spark, str(tmp_path)), con.execute(P.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_null_and_empty_lines_and_documents_without_lines(spark):
    rows = [("a", 0, 0, 0, None), ("b", 0, 5, 0, ""), ("b", 1, 9, 0, "Acme Works")]
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "doc_id string")
    zoned = L.zones(spark.createDataFrame(rows, LINES), F.lit(1000), F.lit(1000))
    got = sorted((r["doc_id"], r["issuer_name"], r["extraction_confidence"], r["error"]) for r in R.extract_batch(asked, zoned).collect())
    assert got == [("a", None, 0.0, None), ("b", "Acme Works", 0.2, None), ("c", None, 0.0, "no lines"), ("c", None, 0.0, "no lines")]
    assert R.extract_batch(asked.limit(0), zoned).count() == 0


def brute_recipient(words, most=6):
    for i, w in enumerate(words[:-1]):
        if w.lower().strip(":.,-") in C.TO_TRIGGERS and words[i + 1].lower().startswith("to"):
            rest = re.sub(r"^to[:\s]*", "", words[i + 1], flags=re.I)
            name = [rest] if rest else []
            for t in [x.strip(":.,-") for x in words[i + 2 : i + 8]]:
                if not t:
                    continue
                if t.lower().startswith((*ADDRESS_WORDS, "http")) or re.match(r"^\d+$", t) or "@" in t or len(name) >= most:
                    break
                name.append(t)
            if name:
                return " ".join(name).strip(",:. ")
    return ""


def test_recipient_from_words(spark):
    rng = random.Random(3)
    pool = ["Bill", "sold:", "ship", "to", "to:", "To:Nina", "Costa,", "12", "Stefan", "a@b.c", "http://x", "-", "Lee", "Bo.", "Total", "Main"]
    rows = [(i, "", [rng.choice(pool) for _ in range(rng.randint(0, 14))]) for i in range(600)] + [(600, None, None), (601, "Kept", ["Bill", "to", "Lee"])]
    df = spark.createDataFrame(rows, "i int, recipient_name string, words array<string>")
    for most in (6, 2):
        got = {r["i"]: r["recipient_name"] for r in C.fallback_recipient(df, most=most).collect()}
        assert got == {i: name or brute_recipient(w or [], most) for i, name, w in rows}
    assert len(set(got.values())) > 50
