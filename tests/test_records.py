"""Fields of annotations and tags, records, boxes, and the corrections after a merge."""

from pyspark.sql import functions as F

from docspark.functions.numeric import box
from docspark.operators import records as R
from docspark.operators.evaluation import FIELDS
from docspark.operators.merging import post_merge


def test_annotated_fields(spark):
    cases = [
        ({"NUMBER": "INVOICE # 12-7\nx", "DATE": "Date: 03-Mar-2021", "DUE_DATE": "Due: next week ", "SELLER_NAME": "Shop\nStreet", "BUYER": " ", "BILL_TO": "Bill to: Jo Roe\n1 Road", "TOTAL": "TOTAL : 441.14 EUR"}, ("12-7", "03-Mar-2021", "next week", "Shop", "Jo Roe", "441.14 EUR")),
        ({"NUMBER": "7788", "DATE": "soon", "SEND_TO": "TO", "AMOUNT_DUE": "Sum 1,000.50 $"}, ("7788", "soon", None, None, "TO", "1,000.50 $")),
        ({"NUMBER": "Invoice no. A1", "BUYER": "Buyer :Ann Lee", "SEND_TO": "other", "TOTAL": "none"}, ("A1", None, None, None, "Ann Lee", "none")),
        ({}, (None,) * 6),
        (None, (None,) * 6),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, fields map<string,string>")
    got = {r.i: tuple(r[f] for f in FIELDS) for r in R.annotated_fields(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_tagged_fields_and_records(spark):
    tags = spark.createDataFrame([(1, 0, "a", "B-X"), (1, 1, "b", "O"), (1, 2, "c", "I-X"), (1, 3, "d", "B-Y")], "doc_id long, pos int, word string, tag string")
    assert {(r.field, r.text) for r in R.tagged_fields(tags).collect()} == {("X", "a c"), ("Y", "d")}
    words = spark.createDataFrame([(1, i, t, 10 * i, 5, 10, 5) for i, t in enumerate(["a", " ", "b ", None, "c"])], "doc_id long, word_id int, text string, left int, top int, width int, height int")
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, class_name string")
    out = {r.doc_id: (r.words, r.boxes) for r in R.dataset_records(docs, words, F.lit(100), F.lit(100), most=2).collect()}
    assert out == {1: (["a", "b"], [[0, 50, 100, 100], [200, 50, 300, 100]]), 2: (["empty"], [[0, 0, 1, 1]])}


def test_boxes(spark):
    df = spark.createDataFrame([(5, 5, 5, 5), (999, 1000, 2000, 2000), (25, 0, 10, 8), (-4, 0, 3, 1)], "l int, t int, r int, b int")
    rows = [tuple(map(tuple, r)) for r in df.select(box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(2000), F.lit(1000)), box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(2000), F.lit(1000), cut=True)).collect()]
    assert rows == [((2, 5, 3, 6), (2, 5, 2, 5)), ((500, 1000, 1000, 1000), (499, 1000, 1000, 1000)), ((12, 0, 13, 8), (5, 0, 12, 8)), ((0, 0, 2, 1), (0, 0, 1, 1))]


def test_post_merge(spark):
    f = "struct<invoice_number:string,recipient_name:string>"
    rows = [
        (0, "2024-03-05", "2024-03-05", "SHIP TO INVOICE # US-001 John Smith", ("", ""), ("", ""), ["x"]),  # a date as the number
        (1, "", "1-Mar-2024", "Ann Lee Ann Lee", ("INV-2024-7", None), None, []),
        (2, None, None, "to: lower AB-1234", None, None, None),
        (3, "INVOICE", None, "—", ("", ""), ("", ""), ["Invoice", "No:", "INV-12345-1"]),
        (4, "", None, "Bob", None, None, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "k int, invoice_number string, invoice_date string, recipient_name string")
    more = spark.createDataFrame([(r[0], *r[4:]) for r in rows], f"k int, improved {f}, two_stage {f}, words array<string>")
    got = {r.k: (r.invoice_number, r.recipient_name) for r in post_merge(df.join(more, "k")).collect()}
    assert got == {0: ("—", "John Smith"), 1: ("INV-2024-7", "Ann Lee"), 2: ("—", "lower"), 3: ("INV-12345-1", ""), 4: ("—", "Bob")}
