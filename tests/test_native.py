"""Fields of native PDFs on pages that reach every pattern, and the answers to uploads."""

import pytest

from docspark.operators.envelope import answers
from docspark.operators.native import native_fields

PAGES = [  # text, then the fields that are found
    ("ACME Ltd\nInvoice No: INV-77/2\nDate: 2024-03-01\nBill To:\nJohn Smith\nGrand Total: $1,250.00", ("INV-77/2", "2024-03-01", None, "ACME Ltd", "John Smith", "1,250.00 USD")),
    ("INVOICE # A-12\nissued 1/2/24\nPayment due: 3/4/2024\nbilled to\nMaria Costa\nTotal ** 88.10 EUR", ("A-12", "1/2/24", "3/4/2024", "issued 1/2/24", "Maria Costa", "88.10 EUR")),
    ("INVOICE 20231\n01.02.2024\nInvoice\nTotal due: 60\n", ("20231", "01.02.2024", None, None, None, "60")),
    ("invoice no 123\ncreated: March 5, 2024\npayable by 1 April 2024\nBalance due 24.00", ("123", "March 5, 2024", "1 April 2024", "created: March 5, 2024", None, None)),  # 24.00 is like a date
    ("Total due 0.5\nAmount due: 700.00", (None, None, None, "Amount due: 700.00", None, "700.00")),  # below 1, so the next pattern
    ("x\nTotal due by 2024-05-06\n 90.00 £", (None, None, "2024-05-06", "x", None, "90.00 GBP")),
    ("Date\nTo\nShip To\n2024-01-02\nJane Roe\n12 Long Street\nTotal 100.", (None, "2024-01-02", None, "Jane Roe", "Jane Roe", "100")),
    ("Date\nTo\n3 Mar 2024\nsame as above\nTo\nPeter Pan", (None, "3 Mar 2024", None, "same as above", "Peter Pan", None)),
    ("date\nother\nthings\nhere\nDate\nTo\n2024-01-02\nX", (None, None, None, "other", None, None)),  # the first such line decides
    ("Order Date\nOrder Number\nDue Date\n2024-01-02\nN7\n2024-02-03", (None, "2024-01-02", "2024-02-03", "N7", None, None)),
    ("Due date: 2024-01-01\nDate 2024-01-01", (None, "2024-01-01", None, None, None, None)),  # a due date equal to the invoice's is none
    ("Payment due 2024-01-05\nDate 2024-01-01\nShip to\n12 Main Street", (None, "2024-01-01", "2024-01-05", "Payment due 2024-01-05", None, None)),
    ("+49 30 1234567\nme@x.org\nhttp://x\n7 Hills\nNice Shop\nBill to\n@none\nShip to\nOther Name", (None, None, None, "Nice Shop", "Other Name", None)),
    ("Invoice number: ABC\nInvoice # 55-1", ("55-1", None, None, None, None, None)),  # a number has a digit
    ("total 1.2.3\nBalance due: 512", (None, None, None, "Balance due: 512", None, "512")),
    (None, (None,) * 6),
    ("", (None,) * 6),
]
FIELDS = ["invoice_number", "invoice_date", "due_date", "issuer_name", "recipient_name", "total_amount"]


def test_native_fields(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAGES)], "i int, text string")
    got = {r.i: tuple(r[f] for f in FIELDS) for r in native_fields(df).collect()}
    for i, (text, want) in enumerate(PAGES):
        assert got[i] == want, text
    with pytest.raises(ValueError, match="_lines"):
        native_fields(df.withColumnRenamed("i", "_lines"))


def test_answers(spark):
    page = ["Shop\nInvoice No: 7788\n" + "text " * 30]
    f, g = {"total_amount": "5"}, {"total_amount": "6"}
    rows = [  # id, filename, size, readable, pages, models_ready, pred_label, confidence, hybrid, one_stage, then status, class, mode, fields, error
        (0, "a.txt", 5, True, None, True, "form", 0.9, None, None, 400, None, None, None, "unsupported file type .txt"),
        (1, "noending", 5, True, None, False, "form", 0.9, None, None, 400, None, None, None, "unsupported file type "),
        (2, "a.PNG", 5, True, None, False, "form", 0.9, None, None, 503, None, None, None, "models are not loaded"),
        (3, "a.png", 0, True, None, True, "form", 0.9, None, None, 400, None, None, None, "file is empty"),
        (4, "a.png", 5, False, None, True, "form", 0.9, None, None, 422, None, None, None, "file cannot be opened"),
        (5, "a.png", 5, True, None, True, None, None, None, None, 500, None, None, None, "inference failed"),
        (6, "a.png", 5, True, None, True, "form", 0.9, f, g, 200, "form", "classified", None, None),
        (7, "a.png", 5, True, None, True, "invoice", 0.8, f, g, 200, "invoice", "hybrid", f, None),
        (8, "a.png", 5, True, None, True, "invoice", 0.8, None, g, 200, "invoice", "one_stage_fallback", g, "main extractor failed; fields are the fallback's"),
        (9, "a.png", 5, True, None, True, "invoice", 0.8, None, None, 500, None, None, None, "inference failed"),
        (10, "x.y.pdf", 5, False, page, True, None, None, None, None, 200, "invoice", "native_pdf_text", {"invoice_number": "7788", "issuer_name": "Shop"}, None),
        (11, "b.pdf", 5, True, ["short"], True, "email", 0.7, None, None, 200, "email", "classified", None, None),
        (12, None, None, None, None, None, None, None, None, None, 400, None, None, None, "unsupported file type "),
    ]
    m = "map<string,string>"
    df = spark.createDataFrame([r[:10] for r in rows], f"id int, filename string, size long, readable boolean, pages array<string>, models_ready boolean, pred_label string, confidence double, hybrid {m}, one_stage {m}")
    out = {r.id: (r.status, r.predicted_class, r.mode, r.fields, r.error) for r in answers(df).collect()}
    assert out == {r[0]: r[10:] for r in rows}
