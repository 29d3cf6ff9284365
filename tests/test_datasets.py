"""Splits, required classes, two-stage extraction, sources of a merge, reports and small sinks, against plain Python and cases made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators.evaluation import FIELDS


def splits(spark, rows, **shares):
    from docspark.operators.datasets import official_or_new_split

    df = spark.createDataFrame(rows, "id long, class string, official string")
    return {r.id: r.split for r in official_or_new_split(df, "official", "class", "id", **shares).collect()}


def test_official_splits(spark):
    rows = [(i, "ab"[i % 2], ["train", "val", "test", None][i % 4]) for i in range(200)]
    assert splits(spark, rows) == {i: o for i, _, o in rows}
    two = [(i, c, "train" if o == "val" else o) for i, c, o in rows]
    got = splits(spark, two)
    assert all(got[i] == o for i, _, o in two if o != "train")
    for c in "ab":
        own = [got[i] for i, x, o in two if x == c and o == "train"]
        assert set(own) == {"train", "val"} and abs(own.count("val") - len(own) * 0.15 / 0.85) <= 1
    for layout in ([(i, c, "train") for i, c, _ in rows], [(i, c, None) for i, c, _ in rows], [(i, c, "extra" if i == 0 else o) for i, c, o in rows]):
        got = splits(spark, layout)
        assert len(got) == 200 and abs(list(got.values()).count("train") - 140) <= 2 and abs(list(got.values()).count("val") - 30) <= 2
    assert splits(spark, rows[:0]) == {}
    with pytest.raises(ValueError, match="sum to 1"):
        splits(spark, rows, train=0.9)


def test_required_classes_and_summary(spark):
    from docspark.operators.datasets import dataset_summary, require_classes, text_coverage

    df = spark.createDataFrame([("a", "train", "x", None), ("b", "test", "x", None), (None, None, "y", None), ("a", None, None, None)], "class_name string, split string, path string, hash string")
    assert require_classes(df, "class_name", ["a", "b"]).count() == 3
    with pytest.raises(ValueError, match="no rows of c, d$"):
        require_classes(df, "class_name", ["a", "c", "d"])
    got = {(r.part, r.name): r.n for r in dataset_summary(df, F.col("class_name").isin("a", "b"), keys=["path", "hash"]).collect()}
    assert got == {("all", None): 4, ("selected", None): 3, ("split", "train"): 1, ("split", "test"): 1, ("class", "a"): 2, ("class", "b"): 1, ("duplicates", "path"): 2, ("duplicates", "hash"): None}
    texts = spark.createDataFrame([("s", None), ("s", " \n"), ("s", "two words"), ("t", "x")], "split string, text string")
    got = {r.split: tuple(r)[1:] for r in text_coverage(texts, "split").collect()}
    assert got == {"s": (3, 2, 66.67, 3.67, 0.67), "t": (1, 0, 0.0, 1.0, 1.0)}


def crop_texts(tokens, words):
    """Plain Python: text of each field's padded region after the two checks."""
    from docspark.operators.two_stage import PADDING

    boxes = {}
    for _, _, field, conf, *b in tokens:
        if conf >= 0.7:
            o = boxes.setdefault(field, list(b))
            boxes[field] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
    area = lambda z: max(0, z[2] - z[0]) * max(0, z[3] - z[1])
    if {"issuer_name", "recipient_name"} <= set(boxes):
        a, b = boxes["issuer_name"], boxes["recipient_name"]
        common = area([max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])])
        if common > 0.5 * (area(a) + area(b) - common):
            del boxes["issuer_name"]
    if {"invoice_number", "due_date"} <= set(boxes):
        a, b = boxes["invoice_number"], boxes["due_date"]
        if all(abs((a[i] + a[i + 2]) / 2 - (b[i] + b[i + 2]) / 2) < 50 for i in (0, 1)):
            del boxes["due_date"]
    out = dict.fromkeys(FIELDS, "")
    for f, b in boxes.items():
        p = PADDING[f]
        b = [max(0, b[0] - p), max(0, b[1] - p), min(1000, b[2] + p), min(1000, b[3] + p)]
        if b[2] - b[0] >= 10 and b[3] - b[1] >= 10:
            out[f] = " ".join(w for _, w, *z in sorted(words) if b[0] <= (z[0] + z[2]) / 2 <= b[2] and b[1] <= (z[1] + z[3]) / 2 <= b[3])
    return out


def test_two_stage_against_plain_python(spark, monkeypatch):
    from docspark.operators import two_stage as T

    rng, tokens, words = random.Random(5), [], []
    for doc in range(60):
        for pos in range(40):
            x, y = rng.randrange(0, 900), rng.randrange(0, 960)
            box = [x, y, x + rng.randrange(5, 90), y + rng.randrange(5, 30)]
            word = rng.choice(["INV-10", "12/03/2024", "Ada", "Lovelace", "$5.00", "street", "Total", "to"])
            words.append((doc, pos, word, *box))
            if rng.random() < 0.25:
                field = rng.choice(FIELDS)
                if rng.random() < 0.3:  # regions on each other
                    box = [100, 100, 180, 115]
                tokens.append((doc, pos, word, field, rng.choice([0.5, 0.7, 0.9]), *box))
    boxes = "x0 int, y0 int, x1 int, y1 int"
    t = spark.createDataFrame(tokens, f"doc_id int, pos int, word string, field string, conf double, {boxes}")
    w = spark.createDataFrame(words, f"doc_id int, pos int, word string, {boxes}")
    want = {d: crop_texts([x[1:] for x in tokens if x[0] == d], [x[1:] for x in words if x[0] == d]) for d in {x[0] for x in tokens}}
    for f in ("invoice_number", "date", "name", "amount"):  # the regions' own texts
        monkeypatch.setattr(T.cleaning, f, lambda x: F.lit(""))
    got = {r.doc_id: {f: r[f] for f in FIELDS} for r in T.two_stage_fields(t, w).collect()}
    assert got == want and any(v["issuer_name"] for v in want.values())
    monkeypatch.undo()
    texts = spark.createDataFrame([(d, *[v[f] for f in FIELDS]) for d, v in want.items()], "doc_id int, " + ", ".join(f"{f} string" for f in FIELDS))
    by = {"invoice_number": T.cleaning.invoice_number, "total_amount": T.cleaning.amount, "issuer_name": T.cleaning.name, "recipient_name": T.cleaning.name, "invoice_date": T.cleaning.date, "due_date": T.cleaning.date}
    cleaned = {r.doc_id: r for r in texts.select("doc_id", *[c(F.col(f)).alias(f) for f, c in by.items()]).collect()}
    got = {r.doc_id: r for r in T.two_stage_fields(t, w).collect()}
    assert all(got[d][f] == (cleaned[d][f] or v[f]) for d, v in want.items() for f in FIELDS)
    assert any(cleaned[d][f] == "" != v[f] for d, v in want.items() for f in FIELDS)  # a region's text stands in
    assert T.two_stage_fields(t.limit(0), w).count() == 0


def test_merge_batch_tells_sources(spark):
    from docspark.operators.merging import merge_batch

    fields = ", ".join(f"{f}: string" for f in FIELDS)
    rec = lambda **v: tuple(v.get(f, "") for f in FIELDS)
    rows = [
        (1, rec(recipient_name="SHIP TO INVOICE # US-001 John Smith", total_amount="£55,00"), rec(recipient_name="—"), []),
        (2, rec(issuer_name="Acme", recipient_name="Acme"), rec(), []),
        (3, rec(invoice_number="A-1"), rec(invoice_number="INVOICE"), ["INV15261847"]),
        (4, rec(recipient_name="# US-001 x", invoice_date="2024-01-02"), rec(recipient_name="Ada Lovelace", invoice_date="2024-01-03", issuer_name="Beta"), []),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, baseline struct<{fields}>, improved struct<{fields}>, ocr array<string>")
    got = {r.doc_id: r for r in merge_batch(df, F.col("ocr")).collect()}
    assert (got[1].recipient_name, got[1].source_recipient_name) == ("John Smith", "cleaned")
    assert (got[1].total_amount, got[1].source_total_amount) == ("£55.00", "cleaned")
    assert got[2].swap_suspected and (got[2].issuer_name, got[2].source_issuer_name, got[2].source_recipient_name) == ("—", "cleaned", "baseline")
    assert (got[3].invoice_number, got[3].source_invoice_number) == ("INV15261847", "cleaned")
    assert (got[4].recipient_name, got[4].source_recipient_name) == ("Ada Lovelace", "improved")
    assert (got[4].source_invoice_date, got[4].source_issuer_name, got[4].source_due_date) == ("improved", "improved", "improved")


def test_report_aligned_vectors_and_json(spark, tmp_path):
    from docspark.functions.numeric import aligned
    from docspark.operators.datasets import mean_vectors
    from docspark.operators.selection import span_report
    from docspark.sources import files

    true = spark.createDataFrame([(1, 0, 1, "A"), (1, 3, 4, "B"), (2, 0, 0, "A")], "doc_id int, start int, end int, field string")
    seen = spark.createDataFrame([(1, 0, 1, "A"), (1, 3, 5, "B"), (2, 7, 8, "C")], true.schema)
    got = {r.field: tuple(round(x, 4) for x in r[1:]) for r in span_report(seen, true).collect()}
    assert got["A"] == (1.0, 0.5, 0.6667, 2) and got["B"] == (0.0, 0.0, 0.0, 1) and got["C"] == (0.0, 0.0, 0.0, 0)
    assert got["micro avg"] == (0.3333, 0.3333, 0.3333, 3) and got["macro avg"] == (0.3333, 0.1667, 0.2222, 3) and got["weighted avg"] == (0.6667, 0.3333, 0.4444, 3)
    p = spark.createDataFrame([([0.2, 0.6],), ([0.0, 0.0],), (None,)], "p array<double>")
    assert [r[0] for r in p.select(aligned(F.col("p"), ["b", "x"], ["a", "b", "x"])).collect()] == [pytest.approx([0.0, 0.25, 0.75]), [0.0] * 3, [0.0] * 3]
    v = spark.createDataFrame([("a", [3.0, 0.0], 1), ("a", [9.0, 9.0], 0), ("a", [3.0, 8.0], 1), ("b", [1.0, 1.0], 0)], "label string, v array<float>, w int")
    got = {r.label: r.v for r in mean_vectors(v, "label", "v", "w").collect()}
    assert got == {"a": pytest.approx([0.6, 0.8]), "b": [0.0, 0.0]}
    files.write_json(p, f"{tmp_path}/j")
    files.write_json(p.limit(1), f"{tmp_path}/j", append=True)
    assert sorted(str(r.p) for r in files.read_json(spark, f"{tmp_path}/j", p.schema).collect()) == ["None", "[0.0, 0.0]", "[0.2, 0.6]", "[0.2, 0.6]"]
    files.write_splits(true.withColumn("split", F.when(F.col("doc_id") == 1, "train").otherwise("test")), f"{tmp_path}/s")
    assert files.read_splits(spark, f"{tmp_path}/s").count() == 3 and files.read_splits(spark, f"{tmp_path}/s", "test").count() == 1


def test_first_cleaner(spark):
    from docspark.operators.cleaning import first_cleaner

    cases = {
        "invoice_date": {"Date: 3-Mar-24 x": "3-Mar-24", " none ": "none", "2024-01-05": "2024-01-05"},
        "total_amount": {"Total usd 1,200.50 due": "usd 1,200.50", "sum 12,5 of": "12,5", "free": "free", "€ 7.00": "€ 7.00"},
        "invoice_number": {"No. INV-1 A77": "A77", "  ": ""},
        "issuer_name": {"Bill To: Ada King Lovelace": "Ada King Lovelace", "one two three four five": "one two three four", "from Tel 5": "from Tel 5", "Acme, 12 Road": "Acme", "bill to": "bill to", "": "—", "—": "—", None: "—"},
    }
    for field, pairs in cases.items():
        df = spark.createDataFrame([(x,) for x in pairs], "x string")
        assert [r[0] for r in df.select(first_cleaner(field, F.col("x"))).collect()] == list(pairs.values()), field


def test_ranges_of_paths_are_many_and_in_order(spark):
    from docspark.operators.catalog import metadata, range_part

    rng = random.Random(3)
    paths = [f"/data/{rng.choice(['train', 'test'])}/invoices/{rng.choice('éa')}{rng.randrange(4000)}.png" for _ in range(3000)]
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, length int")
    got = sorted((r.path, r.part) for r in df.select("path", range_part(df, "path").alias("part")).collect())
    parts = [p for _, p in got]
    assert parts == sorted(parts) and len(set(parts)) > 200 and max(map(parts.count, set(parts))) < 120
    made = sorted(metadata(df).collect(), key=lambda r: r.doc_id)
    assert [r.path for r in made] == sorted(paths) and made[-1].doc_id == "doc_00002999"
    assert metadata(df.limit(0)).count() == 0
