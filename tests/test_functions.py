"""Golden cases of field rules and sequence operators."""

import random
import re

from pyspark.sql import functions as F

from docspark.functions import fields as V
from docspark.functions import numeric as N
from docspark.operators import merging as M
from docspark.operators import sequences as S
from docspark.operators.evaluation import FIELDS


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("y")).collect()]


def test_dates(spark):
    assert one(spark, V.date, "2024-03-05", "13/2/2024", "2/13/24", "March 5, 2024", "5 Mar 2024", "12", "2024", "31/31/2024", None) == ["2024-03-05", "2024-02-13", "2024-02-13", "2024-03-05", "2024-03-05", None, None, None, None]


def test_amounts(spark):
    got = one(spark, V.amount, "$ 1,234.56", "1234.56", "$ 55,00", "0.00", "")
    assert [tuple(x) if x else None for x in got] == [("1234.56", "$"), None, ("5500.00", "$"), None, None]
    assert one(spark, lambda x: V.amount(x, lenient=True)["amount"], "1234.56") == ["1234.56"]


def test_numbers_and_anchors(spark):
    assert one(spark, V.invoice_number, "12345", "(555) 010-1234", "x", "INV-1") == ["12345", None, None, "INV-1"]
    assert one(spark, lambda x: V.after_anchor(x, ["invoice no"]), "Invoice No: INV-001", "none") == ["INV-001", None]
    assert one(spark, V.amounts_in, "$1234.56") == [["$123"]]


def test_share_of_a_page_and_unit_vectors(spark):
    df = spark.createDataFrame([(5.0, 10), (20.0, 10), (-1.0, 10), (5.0, 0), (None, 10)], "x double, size int")
    assert [r[0] for r in df.select(N.unit(F.col("x"), F.col("size"))).collect()][:4] == [0.5, 1.0, 0.0, 0.0]
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(N.unit_vector(F.col("a")), N.unit_vector(F.col("b"))).first()
    assert [round(x, 9) for x in r[0]] == [0.6, 0.8] and r[1] == [0.0, 0.0]


def merged(spark, baseline, improved, candidates=None):
    row = [tuple(d.get(f) for f in FIELDS) for d in (baseline, improved)]
    kind = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
    df = spark.createDataFrame([("d", *row, candidates)], f"doc_id string, baseline {kind}, improved {kind}, c array<string>")
    return M.merge_two(df, F.col("c")).first().asDict()


def test_merge_two(spark):
    r = merged(spark, {"recipient_name": "SHIP TO INVOICE # US-001 John Smith"}, {"recipient_name": "—"})
    assert r["recipient_name"] == "John Smith"
    r = merged(spark, {"issuer_name": "John Smith", "recipient_name": "John Smith"}, {"issuer_name": "John Smith", "recipient_name": "John Smith"})
    assert r["issuer_name"] == "—" and r["swap_suspected"]
    assert merged(spark, {"total_amount": "—"}, {"total_amount": "£55,00"})["total_amount"] == "£55.00"
    assert merged(spark, {"invoice_number": "—"}, {"invoice_number": "INVOICE"}, ["abc", "INV15261847"])["invoice_number"] == "INV15261847"


def brute_order(items, gap=15):
    rows = []
    for i, (x, y) in sorted(enumerate(items), key=lambda t: (t[1][1], t[0])):
        for r in rows:
            if abs(y - sum(items[j][1] for j in r) / len(r)) <= gap:
                r.append(i)
                break
        else:
            rows.append([i])
    rows.sort(key=lambda r: sum(items[j][1] for j in r) / len(r))
    return [i for r in rows for i in sorted(r, key=lambda j: items[j][0])]


def test_reading_order(spark):
    rng = random.Random(3)
    pages = [[(rng.randint(0, 1000), rng.randint(0, 200)) for _ in range(rng.randint(0, 30))] for _ in range(25)]
    df = spark.createDataFrame([(k, [(x, y, i) for i, (x, y) in enumerate(p)]) for k, p in enumerate(pages)], "k int, items array<struct<x0:int,y0:int,pos:int>>")
    got = {r.k: [x.pos for x in r.o] for r in df.select("k", S.reading_order(F.col("items")).alias("o")).collect()}
    assert got == {k: brute_order(p) for k, p in enumerate(pages)}


def test_spans_with_orphans(spark):
    tags = ["I-A", "I-A", "O", "B-B", "I-B", "I-A", "B-A", "B-A"]
    df = spark.createDataFrame([(1, i, f"w{i}", t, 0.5) for i, t in enumerate(tags)], "doc_id int, pos int, word string, tag string, conf double")
    lenient = {(r.field, r.text) for r in S.spans(df).collect()}
    assert lenient == {("A", "w0 w1"), ("B", "w3 w4"), ("A", "w5"), ("A", "w6"), ("A", "w7")}
    assert {(r.field, r.text) for r in S.spans(df, strict=True).collect()} == {("B", "w3 w4"), ("A", "w6"), ("A", "w7")}


def test_reading_order_of_whole_pages(spark, tmp_path):
    from docspark.plans.catalog import x01_reading_order
    from docspark.plans.ocr import raw_words

    texts = [(k, " ".join("w" * (1 + (i * i + k) % 9) for i in range(n))) for k, n in enumerate([1, 59, 61, 399, 401, 950])] + [(7, ""), (8, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = {}
    for r in raw_words(spark, str(tmp_path)).orderBy("doc_id", "word_num").collect():
        if r.text.strip() and r.conf >= 10:
            pages.setdefault((r.doc_id, r.page_num), []).append((r.word_num, (round(r.left), round(r.top / 1400 * 1000))))
    assert max(map(len, pages.values())) > 300
    got = {(r.doc_id, r.page_num): r.order for r in x01_reading_order(spark, str(tmp_path)).collect()}
    assert got == {k: [p[i][0] for i in brute_order([xy for _, xy in p])] for k, p in pages.items()}


def brute_flags(w):
    c = w.strip()
    n = len(c)
    if not n:
        return [False] * 12
    patterns = [r"^(?:[$€£¥₹])?\s*\d+[\d,\.]*$", r"^(?:\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4}|\d{4}[\-/]\d{1,2}[\-/]\d{1,2}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4})$", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", r"(?i)^(?:https?://|www\.)", r"^(?:\+?\d[\d\s().-]{6,}\d)$"]
    punct = sum(not x.isalnum() and not x.isspace() for x in c)
    return [c.isdigit(), c.isalpha(), c.isalnum(), c.isupper() and n > 1, punct / n >= 0.3, n <= 2, n >= 12, *[bool(re.match(p, c)) for p in patterns]]


def test_flags_of_all_words(spark, tmp_path):
    from docspark.plans.text import f05_all_token_flags

    pieces = ["Straße", "ÜBER", "É", "ñandú", "中文字", "١٢٣", "²", "x²", "Ⅻ", "ⅻ", "ǅ", "ǅA", "€1.234,50", "₹\xa0500", "$12", "3/4/2024", "2024-03-05", "5\xa0May\xa02024", "a@b.org", "HTTPS://x", "www.é", "+49\xa030 1234567", "(030)12-3456", "030-1234567", "__", "a_b", "—", "½", "\xa0", "\u2003x\u2003", "Donaudampfschiff", "ªº", "😀😀", "ABC1", "e\u0301", "①", "ß", "0,5", "\x1cA\x1f", "ΑΒΓ", "١/٢/٢٠٢٤"]
    rng = random.Random(4)
    texts = [(i, p) for i, p in enumerate(pieces)] + [(100 + i, rng.choice([" ", "\n", "\t "]).join(rng.choices(pieces, k=40))) for i in range(10)] + [(200, ""), (201, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["numeric", "alpha", "alnum", "upper", "punct", "short", "long", "currency", "date", "email", "url", "phone"]
    got = {r.doc_id: [r.n, *[r[f"n_{k}"] for k in names]] for r in f05_all_token_flags(spark, str(tmp_path)).collect()}
    expect = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        expect[i] = [len(w), *[sum(x) for x in zip(*map(brute_flags, w), [False] * 12)]]
    assert got == expect


def test_topic_terms_and_shares(spark, tmp_path):
    from docspark.functions.text import tokens
    from docspark.operators.features import topic_terms
    from docspark.plans.catalog import m10_topics

    assert one(spark, lambda x: topic_terms(tokens(x)), "The invoice total of a invoice", "the", "", None) == [["invoice", "total", "invoice", "invoice total", "total invoice"], [], [], []]
    texts = [(i, "red apple pear" if i % 2 else "steel bolt nut") for i in range(40)] + [(40, ""), (41, None), (42, "the of")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.topics for r in m10_topics(spark, str(tmp_path)).collect()}
    assert len(got) == 43 and all(len(t) == 5 and abs(sum(t) - 1) < 1e-9 for t in got.values())
    assert got[40] == got[41] == got[42] == [0.2] * 5
    best = [max(range(5), key=got[i].__getitem__) for i in range(40)]
    assert len(set(best[::2])) == len(set(best[1::2])) == 1 and best[0] != best[1]


def test_probabilities_and_merged_totals(spark, tmp_path):
    from docspark.plans.catalog import m17_language_probabilities
    from docspark.plans.text import a24_merged_totals

    for r in m17_language_probabilities(spark, "/root/testdata/sf0.001").collect():
        p = {k.removeprefix("confidence_"): v for k, v in r.asDict().items() if k.startswith("confidence_")}
        assert len(p) == 4 and abs(sum(p.values()) - 1) < 1e-9 and p[r.pred_label] == max(p.values())
    spark.createDataFrame([(1, "total:5 x camelCaseWord"), (2, "to:Nicole"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert a24_merged_totals(spark, str(tmp_path)).first().asDict() == {"total": 2, "mean": 0.5, "examples": 1}
