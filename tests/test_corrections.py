"""Corrections of fields against plain versions of the same rules."""

import random
import re

from pyspark.sql import functions as F

from docspark.operators import corrections as C

D = re.compile(C.DATE[4:], re.I)


def plain(words):
    return [w.lower().strip(":.,-") for w in words]


def has(words, a, b, labels):
    return any(x in " ".join(words[max(0, a) : max(0, b)]) for x in labels)


def brute_fallback(words, issue, due):
    p = plain(words)
    for i in range(len(words)):
        for w in words[i + 1 : i + 5]:
            if m := D.search(w):
                x = m[0].strip()
                if has(p, i - 1, i + 2, C.DUE_LABELS_OF_CLEANER) and not due and x != issue:
                    due = x
                elif has(p, i - 1, i + 2, C.ISSUE_LABELS) and not issue and x != due:
                    issue = x
                break
    return issue, due


def brute_arbitrate(words, issue, due):
    dates = [(i, m[0].strip()) for i, w in enumerate(words) if (m := D.search(w))]
    if bool(issue) == bool(due) or len(dates) < 2:
        return issue, due
    own, foreign = (C.ISSUE_LABELS, C.DUE_LABELS_OF_CLEANER) if due else (C.DUE_LABELS_OF_CLEANER, C.ISSUE_LABELS)
    rest = [(i, x) for i, x in dates if x != issue + due]
    good = [x for i, x in rest if has(plain(words), i - 5, i + 2, own) or not has(plain(words), i - 5, i + 2, foreign)]
    pick = (good or [x for _, x in rest] or [""])[0]
    return (pick, due) if due else (issue, pick)


def cases(n=150):
    rng = random.Random(8)
    pool = ["Invoice", "date:", "Due", "payment", "2024-01-05", "2024-02-09", "3/4/2024", "total", "x", "Acme", "expires", "(12-Mar-2024)", "5", "the"]
    dates = ["", "", "2024-01-05", "2024-02-09"]
    return [(i, [rng.choice(pool) for _ in range(rng.randint(0, 14))], rng.choice(dates), rng.choice(dates)) for i in range(n)]


def test_missing_and_swapped_dates(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "k int, words array<string>, invoice_date string, due_date string")
    for f, brute in ((C.fallback_dates, brute_fallback), (C.arbitrate_dates, brute_arbitrate)):
        got = f(df)
        assert got.columns == df.columns
        for r in got.collect():
            assert (r.invoice_date, r.due_date) == brute(*rows[r.k][1:]), rows[r.k]


def test_gate(spark):
    fields = list(C.THRESHOLDS)
    row = {f: "v" for f in fields} | {f"{f}_conf": t for f, t in zip(fields, (0.7, 0.69999, None, 0.95, 0.5, 0.123456), strict=True)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join([f"{f} string" for f in fields] + [f"{f}_conf double" for f in fields]))
    out = C.gate(df).first()
    assert [out[f] for f in fields] == ["v", "", "", "v", "v", ""]
    assert [out[f"{f}_conf"] for f in fields] == [0.7, 0.7, 0.0, 0.95, 0.5, 0.1235]


def test_rules(spark):
    base = dict.fromkeys(C.THRESHOLDS, "") | {"invoice_number": "INV-77", "invoice_date": "2024-01-05", "due_date": "2024-02-09", "issuer_name": "Acme", "recipient_name": "Bo", "total_amount": "$ 90.00"}
    table = [
        ({}, "nothing", {}, []),
        ({"due_date": "2024-01-05"}, "Invoice date 2024-01-05 x x x x x Due 2024-02-09", {"due_date": "2024-02-09"}, ["RULE1"]),
        ({"due_date": "2024-01-05"}, "a 2024-03-01 b b b b b b 2024-04-02", {"invoice_date": "2024-03-01", "due_date": "2024-04-02"}, ["RULE1"]),
        ({"due_date": "2024-01-05"}, "only 2024-01-05 here", {"due_date": "2024-01-05"}, ["RULE1"]),
        ({"total_amount": "24.09"}, "pay $ 1,234.50 now", {"total_amount": "$ 1,234.50"}, ["RULE2"]),
        ({"total_amount": "31.13"}, "pay $ 1,234.50 now", {"total_amount": "31.13"}, []),
        ({"total_amount": "abc"}, "no sum", {"total_amount": ""}, ["RULE2"]),
        ({"total_amount": "1.2.3"}, "Total: 0.50 and total: 77.10", {"total_amount": ""}, ["RULE2"]),
        ({"invoice_number": "TO"}, "Invoice No: INV-123", {"invoice_number": "INV-123"}, ["RULE3"]),
        ({"invoice_number": ""}, "lower words only", {"invoice_number": "2024-01-05"}, ["RULE3"]),  # a date under a label with "invoice" is a candidate
        ({"due_date": "9-3/22"}, "x", {"due_date": ""}, ["RULEX"]),
        ({"issuer_name": "Acme Ltd, info@acme.com 12 Road"}, "x", {"issuer_name": "Acme Ltd"}, ["RULE4 issuer_name"]),
        ({"recipient_name": "one two three four five six seven " * 3}, "x", {"recipient_name": "one two three four five six"}, ["RULE4 recipient_name"]),
        ({"invoice_date": "", "due_date": ""}, "Date: 2024-05-06 Due: 2024-05-06 Payment 7/8/2024", {"invoice_date": "2024-05-06", "due_date": "7/8/2024"}, ["RULE5 invoice_date", "RULE5 due_date"]),
        ({"total_amount": ""}, "Grand Total : € 88.00", {"total_amount": "€ 88.00"}, ["RULE5 total_amount"]),
    ]
    rows = [(k, *(base | given).values(), text.split(" ")) for k, (given, text, _, _) in enumerate(table)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{f} string" for f in base) + ", words array<string>")
    for r in C.validate_and_correct(df).collect():
        given, _, changed, notes = table[r.k]
        assert ({f: r[f] for f in base}, r.validation_notes) == (base | given | changed, notes), table[r.k]
    none = spark.createDataFrame([(None,) * 7], ", ".join(f"{f} string" for f in base) + ", words array<string>")
    assert C.validate_and_correct(none).first().invoice_number == "—"


def test_queries(spark):
    from docspark.plans.clean import QUERIES, _noted

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    out = QUERIES["x17_validate_and_correct"](spark, d).collect()
    assert len(out) == n and {x for r in out for x in r.validation_notes} >= {"RULE1", "RULE2", "RULE3", "RULEX", "RULE4 issuer_name", "RULE5 due_date", "RULE5 total_amount"}
    spans = QUERIES["x14_x15_dates"](spark, d)
    rows = {r.doc_id: r for r in _noted(spark, d).collect()}
    for r in spans.collect():
        g = rows[r.doc_id]
        issue, due = brute_fallback(g.words, g.invoice_date, g.due_date)
        assert (r.invoice_date, r.due_date) == brute_arbitrate(g.words, issue, due)
