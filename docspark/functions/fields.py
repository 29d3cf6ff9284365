"""Validators and rules for the fields of an invoice. Each returns a Column: the cleaned value, or null where a candidate is not valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import DASH, first_value, letters_and_digits, without_ocr_marks

# Currency signs, month names, words of addresses and labels.
SIGNS = "$€£¥₹"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
ADDRESS = r"(?i)\b(street|st\.|avenue|ave\.|road|rd\.|boulevard|blvd|suite|ste\.|floor|fl\.|po\s+box|p\.o\.|zip|postal|\d{5})\b"
DATES = rf"(?i)\b(?:\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|\d{{4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,2}}|{MONTH}[\s.,]{{0,2}}\d{{1,2}}[\s.,]{{0,2}}\d{{2,4}}|\d{{1,2}}[\s.,]{{0,2}}{MONTH}[\s.,]{{0,2}}\d{{2,4}})\b"
AMOUNTS = rf"(?:[{SIGNS}]\s*\d{{1,3}}(?:[,\s]\d{{3}})*(?:\.\d{{1,2}})?|\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?|\d{{4,}}(?:\.\d{{1,2}})?|\d{{1,3}}(?:[,\s]\d{{3}})*(?:\.\d{{1,2}})?\s*[{SIGNS}])"
LABELS_ONLY = ["INVOICE", "ID", "BUYER", "REF"]


def _group(x: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def date(raw: Column, pivot: int = 2069) -> Column:
    """ISO date of a string that is a whole date: year first; month first, or day first where the month would exceed 12; or with a month's name. Years of two digits lie in the hundred years up to `pivot`. Partial dates are not accepted."""
    x = without_ocr_marks(raw)
    ymd, num = r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$", r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    named, dayed = rf"(?i)^({MONTH})[\s.,]{{0,2}}(\d{{1,2}})[\s.,]{{0,2}}(\d{{4}}|\d{{2}})$", rf"(?i)^(\d{{1,2}})[\s.,]{{0,2}}({MONTH})[\s.,]{{0,2}}(\d{{4}}|\d{{2}})$"
    month = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    number = lambda c: c.cast("int")

    def year(c: Column) -> Column:
        y, base = number(c), pivot - pivot % 100
        return F.when(F.length(c) > 2, y).otherwise(F.when(y <= pivot % 100, base + y).otherwise(base - 100 + y))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")

    a, b = number(_group(x, num, 1)), number(_group(x, num, 2))
    swap = a > 12
    each = [
        (ymd, made(number(_group(x, ymd, 1)), number(_group(x, ymd, 2)), number(_group(x, ymd, 3)))),
        (num, made(year(_group(x, num, 3)), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b))),
        (named, made(year(_group(x, named, 3)), month(_group(x, named, 1)).cast("int"), number(_group(x, named, 2)))),
        (dayed, made(year(_group(x, dayed, 3)), month(_group(x, dayed, 2)).cast("int"), number(_group(x, dayed, 1)))),
    ]
    return F.date_format(F.coalesce(*[F.when(x.rlike(p), v) for p, v in each]), "yyyy-MM-dd")


def amount(raw: Column, lenient: bool = False) -> Column:
    """struct(amount with two decimals, symbol or null). Grouped digits only, unless lenient; commas are deleted; 0 < value <= 999,999,999."""
    x = without_ocr_marks(raw)
    digits = r"(?:\d{1,3}(?:[,.\s]\d{3})*|\d+)" if lenient else r"\d{1,3}(?:[,.\s]\d{3})*"
    ok = x.rlike(rf"^[{SIGNS}]?\s*{digits}(?:[.,]\d{{1,2}})?\s*[{SIGNS}]?$")
    value = F.regexp_replace(x, rf"[{SIGNS}\s,]", "").try_cast("double")
    good = ok & (value > 0) & (value <= 999_999_999)
    return F.when(good, F.struct(F.format_string("%.2f", value).alias("amount"), _group(x, f"[{SIGNS}]", 0).alias("symbol")))


def is_phone(raw: Column) -> Column:
    x = without_ocr_marks(raw)
    n = F.length(F.regexp_replace(x, r"\D", ""))
    return (n >= 7) & x.rlike(r"^[+(]?[\d\s\-.()]{7,}\d$") | n.isin(10, 11)


def is_date_like(raw: Column) -> Column:
    """Whether a lenient reader of dates takes the string for one, whole or in part: what `date` reads; a number of up to four digits but 0, as a day or a year; six digits as day, month and year in the order that their sizes allow; two numbers joined by - or / as month and day, or with a year; a month's name, alone or with a number."""
    x = without_ocr_marks(raw)
    two, six, named = r"^(\d{1,4})[/\-](\d{1,4})$", r"^(\d{2})(\d{2})(\d{2})$", rf"(?i)^(?:{MONTH}[\s.,\-/]{{0,2}}\d{{0,4}}|\d{{1,4}}[\s.,\-/]{{0,2}}{MONTH})$"
    part = lambda p, i: F.regexp_extract(x, p, i).try_cast("int")
    year = lambda y: F.when(y < 70, 2000 + y).when(y < 100, 1900 + y).otherwise(y)
    real = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", year(y), m, d), "yyyy-MM-dd").isNotNull()
    a, b, c = (part(six, i) for i in (1, 2, 3))
    as_six = F.when(a > 31, real(a, b, c)).when(a > 12, real(c, b, a)).otherwise(real(c, a, b))
    p, q = part(two, 1), part(two, 2)
    as_two = F.when(p > 31, q.between(1, 12)).when(q > 31, p.between(1, 12)).otherwise(real(F.lit(2000), p, q))
    partial = F.when(x.rlike(r"^\d{1,4}$"), x.try_cast("int") > 0).when(x.rlike(six), as_six).when(x.rlike(two), as_two).otherwise(x.rlike(named))
    return F.coalesce(date(raw).isNotNull() | partial, F.lit(False))


#: Letters and digits in one piece, with a letter that does not name a telephone: its digits are a code's, also if they are as many as a telephone's.
CODE = r"(?i)^(?!tel|phone|fax|mob|cell|call)(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Z0-9]+(?:[-/][A-Z0-9]+)*$"


def invoice_number(raw: Column, strict_compat: bool = False) -> Column:
    """The string without OCR marks if it has 2 to 40 signs, a letter or digit among them, and is neither a phone number (a code with letters is none) nor a date; with strict_compat, nor date-like, so that short numbers are rejected, and a code of 10 or 11 digits is a phone number."""
    x = without_ocr_marks(raw)
    other = ~is_phone(x) & ~is_date_like(raw) if strict_compat else (x.rlike(CODE) | ~is_phone(x)) & date(x).isNull()
    return F.when(F.length(x).between(2, 40) & x.rlike("[A-Za-z0-9]") & other, x)


def name(raw: Column) -> Column:
    x = without_ocr_marks(raw)
    return F.when((F.length(x) >= 2) & ~F.regexp_replace(x, r"\s", "").rlike(r"^\d+$") & ~x.rlike(ADDRESS), x)


def differ(issuer: Column, recipient: Column) -> Column:
    """False only if both are given and equal up to case and punctuation."""
    a, b = F.coalesce(issuer, F.lit("")), F.coalesce(recipient, F.lit(""))
    return (a == "") | (b == "") | (letters_and_digits(a) != letters_and_digits(b))


def confidence(fields: dict[str, Column]) -> Column:
    """Sum of fixed weights of the fields that have a value."""
    weights = {"invoice_number": 0.20, "invoice_date": 0.20, "due_date": 0.10, "issuer_name": 0.20, "recipient_name": 0.20, "total_amount": 0.10}
    given = [F.when(F.trim(fields[k]) != "", w).otherwise(0.0) for k, w in weights.items()]
    return F.bround(sum(given[1:], given[0]), 3)


def dates_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATES), 0)


def amounts_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNTS), 0), lambda x: F.trim(x))


def after_anchor(line: Column, anchors: Sequence[str]) -> Column:
    """What follows the first anchor of the list that the line holds and that something follows."""
    low = F.lower(line)

    def rest(a: str) -> Column:
        at = F.instr(low, F.lit(a))
        tail = F.trim(F.ltrim(F.trim(F.substring(line, at + len(a), F.length(line))), F.lit(":# \t")))
        return F.when(at > 0, F.nullif(tail, F.lit("")))

    return F.coalesce(*map(rest, anchors))


def due_from_terms(iso: Column, text: Column) -> Column:
    """struct(due, inferred): the invoice date plus the days of "net N"; nulls and false without either."""
    days = _group(text, r"(?i)\bnet\s*(\d+)\b", 1).try_cast("int")
    due = F.date_format(F.date_add(F.try_to_date(iso, "yyyy-MM-dd"), days), "yyyy-MM-dd")
    return F.struct(due.alias("due"), due.isNotNull().alias("inferred"))


def number_rank(candidate: Column, labelled: Column) -> Column:
    """0 structured with separators, 1 INV and eight digits, 2 short reference under an invoice label, 3 digits only, 4 anything with a digit, 99 the rest."""
    u = F.upper(F.trim(candidate))
    digit = u.rlike("[0-9]")
    return (
        F.when(u.rlike(r"^(?:INV(?:OICE)?[/-]?)?[A-Z0-9]+(?:[-/][A-Z0-9]+)+$") & digit, 0)
        .when(u.rlike(r"^INV\d{8}$"), 1)
        .when(labelled & u.rlike(r"^[A-Z]{2,}-\d{3}$"), 2)
        .when(u.rlike(r"^\d+$"), 3)
        .when(digit, 4)
        .otherwise(99)
    )


def candidate(x: Column) -> Column:
    return F.trim(F.trim(x), F.lit(",:;#()[]{}"))


def is_label_only(x: Column) -> Column:
    return F.upper(F.trim(x)).isin(LABELS_ONLY)


def is_empty(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")).isin("", DASH), F.lit(True))


def is_issuer_garbage(x: Column) -> Column:
    """Blank, an address of any kind, a label, a phone number, too long, or with few letters."""
    s = F.trim(F.coalesce(x, F.lit("")))
    digits, alpha = F.regexp_count(s, F.lit(r"\d")), F.regexp_count(s, F.lit(r"(?U)\p{L}"))
    return (
        (s == "")
        | s.contains("@")
        | F.lower(s).rlike(r"http|www\.")
        | s.rlike(r"(?i)\b(?:invoice|bill\s+to|ship\s+to|due\s+date|total|amount|purchase\s+order|p\.o\.?\s*#?)\b")
        | s.rlike(r"\+?\d[\d\-()\s]{7,}")
        | s.rlike(r",\s*[A-Z]{2}\s+\d{5}\b")
        | s.rlike(r"(?i)\b(?:street|st\.|avenue|ave|road|rd\.|drive|dr\.|lane|ln\.|court|ct\.|square|sq\.)\b")
        | (F.length(s) > 80)
        | (F.size(F.split(s, r"\s+")) > 10)
        | (digits >= 4)
        | (alpha == 0)
        | (alpha / F.greatest(F.length(s), F.lit(1)) < 0.40)
    )


# What makes the name of a recipient look noisy.
NOISE = [r"\+?\d[\d\-()\s]{7,}", r",\s*[A-Z]{2}\s+\d{5}", r"(?i)\b(?:Street|St\.|Ave|Road|Drive|Lane|Court|Square)\b", r"(?i)\b(?:INVOICE|SHIP\s+TO|BILL\s+TO|FROM|TO)\b"]


def is_noisy(x: Column) -> Column:
    s, out = F.trim(x), F.lit(False)
    for p in NOISE:
        out = out | s.rlike(p)
    return ~is_empty(x) & (out | s.contains("!") | s.contains("#") | s.rlike("[A-Za-z]") & s.rlike(r"\d") | (F.length(s) > 40))


def without_noise(x: Column) -> Column:
    """Noise deleted; the last chunk of two or more capitalised words, where there is one."""
    s = F.coalesce(x, F.lit(""))
    for p in NOISE:
        s = F.regexp_replace(s, p, " ")
    s = F.regexp_replace(F.replace(s, F.lit("#"), F.lit(" ")), r"\b[A-Z]{2,}-\d{2,}\b", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "), F.lit(" ,.-"))
    chunks = F.regexp_extract_all(s, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), 0)
    return F.when(is_empty(x), "").otherwise(F.coalesce(F.try_element_at(chunks, F.lit(-1)), s))


def once(x: Column, tail: bool = False) -> Column:
    """A name that is written twice in a row, once. tail: also drop a last word equal to the first."""
    t = F.split(F.trim(x), r"\s+")
    half = F.floor(F.size(t) / 2).cast("int")
    twice = (half > 0) & (F.slice(t, 1, F.greatest(half, F.lit(1))) == F.slice(t, half + 1, F.greatest(half, F.lit(1))))
    out = F.when(twice, F.array_join(F.slice(t, 1, F.greatest(half, F.lit(1))), " "))
    if tail:
        out = out.when((F.size(t) >= 3) & (F.lower(F.get(t, F.lit(0))) == F.lower(F.element_at(t, -1))), F.array_join(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1))), " "))
    return out.otherwise(x)


def symbol(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), "[€$£¥₹₩]", 0)


def comparable_number(x: Column) -> Column:
    """Digits, points and commas only; commas are points if there is no point, else deleted."""
    n = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9.,]", "")
    return F.replace(F.when(n.contains(",") & ~n.contains("."), F.replace(n, F.lit(","), F.lit("."))).otherwise(n), F.lit(","), F.lit(""))


def keep_symbol(merged: Column, two: Column, one: Column) -> Column:
    """The merged amount; with the one-stage symbol if it has none and both stages read the same number."""
    m, a, b = F.trim(merged), comparable_number(two), comparable_number(one)
    same = (a != "") & (a == b)
    return (
        F.when(is_empty(merged), "")
        .when((symbol(m) != "") | (symbol(one) == ""), m)
        .when(is_empty(two), F.trim(one))
        .when(same, F.concat(symbol(one), m))
        .otherwise(m)
    )


def decimal_point(x: Column) -> Column:
    """A currency sign, digits, a comma and two digits: the comma is a decimal point."""
    return F.when(x.rlike(r"^[£$€]\d+,\d{2}$"), F.replace(x, F.lit(","), F.lit("."))).otherwise(x)
