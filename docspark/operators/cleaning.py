"""Cleaning of raw field values that a token model gives: dates, amounts, numbers, names. Column expressions; '' where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in their order, currency codes, words that start an address, words that label a name.
DATES = [
    r"\b(\d{4})[-/](\d{2})[-/](\d{2})\b",
    r"\b(\d{1,2})[-/]([A-Za-z]{3,9})[-/](\d{2,4})\b",
    r"\b([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})\b",
    r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})\b",
    r"\b(\d{4})[./](\d{1,2})[./](\d{1,2})\b",
]
CODES = "USD|EUR|GBP|CAD|AUD|CHF|JPY|CNY|INR|MXN|BRL"
SIGNS = "$€£¥₹₩"
AMOUNTS = [
    rf"(?i)(?:{CODES})\s*(\d[\d,.\s]*\d|\d)",
    rf"(?i)(\d[\d,.\s]*\d|\d)\s*(?:{CODES})",
    rf"([{SIGNS}]\s*\d[\d,.\s]*\d|[{SIGNS}]\s*\d)",
    rf"(\d[\d,.\s]*\d|\d)\s*[{SIGNS}]",
    r"(\d{1,3}(?:[,]\d{3})*\.\d{2}|\d+\.\d{2})",
]
NUMBER = r"(?i)^(?:[A-Z0-9][-A-Z0-9/]{2,}[A-Z0-9]|[A-Z]{1,4}[-\s]?\d{3,}|\d{4,}[-A-Z0-9]*)\b"
ADDRESS_WORDS = "address addr street st ave avenue road rd boulevard blvd lane ln drive dr court ct apt apartment suite ste floor fl po box tel tele phone fax mob mobile cell email e-mail mail site web website http https www gstin gst vat tax ein pan tin zip postal postcode country state province city".split()
NAME_LABELS = "bill billed billing to from attn attention sold ship shipped send sent client customer buyer purchaser vendor supplier seller issuer invoice invoiced recipient payee payer company co corp inc ltd llc".split()


def _found(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))


def date(raw: Column) -> Column:
    """The first match of the first pattern that matches, as it stands."""
    return F.coalesce(*[F.trim(_found(raw, p)) for p in DATES], F.lit(""))


def normal_amount(raw: Column) -> Column:
    """Number and code, or sign and number: label words and blanks inside of the number go; '' without a digit."""
    x = F.trim(raw)
    code, sign = F.upper(F.regexp_extract(x, rf"(?i)\b({CODES})\b", 1)), F.regexp_extract(x, f"[{SIGNS}]", 0)
    n = F.regexp_replace(x, rf"(?i)\b(?:{CODES})\b", "")
    n = F.when(sign != "", F.regexp_replace(n, f"[{SIGNS}]", "")).otherwise(n)
    n = F.trim(F.regexp_replace(n, r"(?i)\b(?:total|amount|balance|due|grand|net|sub)\b", ""), F.lit(":.,-() "))
    n = F.trim(F.regexp_replace(n, r"(?<=\d)\s+(?=\d)", ""))
    return F.when(~n.rlike(r"\d"), "").when(code != "", F.concat(n, F.lit(" "), code)).otherwise(F.concat(sign, n))


def amount(raw: Column) -> Column:
    return F.coalesce(*[F.nullif(normal_amount(_found(raw, p)), F.lit("")) for p in AMOUNTS], F.lit(""))


def _words(raw: Column) -> Column:
    return F.filter(F.split(F.coalesce(raw, F.lit("")), r"\s+"), lambda w: w != "")


def invoice_number(raw: Column, least: int = 3) -> Column:
    """From the right: a word of the number pattern with a digit; else one with a digit; else the last word."""
    w = F.reverse(F.transform(_words(raw), lambda t: F.trim(t, F.lit(":.,-#()"))))
    good = F.filter(w, lambda t: (F.length(t) >= least) & t.rlike(NUMBER) & t.rlike(r"\d"))
    some = F.filter(w, lambda t: t.rlike(r"\d") & (F.length(t) >= 2))
    return F.coalesce(F.get(good, F.lit(0)), F.get(some, F.lit(0)), F.get(w, F.lit(0)), F.lit(""))


def name(raw: Column, most: int = 6) -> Column:
    """Leading label words go; then words up to the first that starts like an address word, is a number, an e-mail or URL, or a phone number; `most` at most. An address word counts as a prefix, so a name that begins with one ends there."""
    bare = lambda t: F.trim(F.lower(t), F.lit(":.,-"))
    w = _words(raw)
    first = F.aggregate(w, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, t: F.struct((a["n"] + F.when(a["go"] & bare(t).isin(NAME_LABELS), 1).otherwise(0)).alias("n"), (a["go"] & bare(t).isin(NAME_LABELS)).alias("go")), lambda a: a["n"])
    rest = F.slice(w, first + 1, F.greatest(F.size(w), F.lit(1)))
    starts = "^(?:" + "|".join(ADDRESS_WORDS) + ")"
    stop = lambda t: bare(t).rlike(starts) | bare(t).rlike(r"^\d+$") | (bare(t).rlike(r"^\d") & (F.length(bare(t)) > 2)) | bare(t).contains("@") | bare(t).rlike(r"^\+?\(?\d[\d\s\-().]{5,}$")
    end = F.coalesce(F.nullif(F.array_position(F.transform(rest, stop), True), F.lit(0)) - 1, F.size(rest)).cast("int")
    return F.trim(F.array_join(F.slice(rest, 1, F.least(end, F.lit(most))), " "), F.lit(",:.-() "))


def tagged(fields: dict[str, Column]) -> Column:
    """Fields as one string of tags, in the order given."""
    return F.concat(F.lit("<s_invoice>"), *[F.concat(F.lit(f"<s_{k}>"), F.coalesce(v, F.lit("")), F.lit(f"</s_{k}>")) for k, v in fields.items()], F.lit("</s_invoice>"))


def untagged(text: Column, field: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?s)<s_{field}>(.*?)</s_{field}>", 1))


# Fixed values of the first cleaner: its patterns, words that end a name by their start, words in front of one.
FIRST_DATE = r"\d{1,2}[-/][A-Za-z]{3,9}[-/]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{2}[-/]\d{2}"
FIRST_AMOUNT = r"(?i)\d[\d,\.]+\s*(?:USD|EUR|GBP|CAD|AUD)|(?:USD|EUR|GBP|CAD|AUD)\s*\d[\d,\.]+|[$€£]\s*\d[\d,\.]+"
FIRST_NUMBER = r"\d[\d,\.]+"
FIRST_STOPS = "tel phone fax email e-mail site web http https www address addr gstin gst vat".split()
FIRST_LABELS = "bill to billed sold send from by".split()


def first_cleaner(field: str, raw: Column, most: int = 4) -> Column:
    """The cleaner before the present one: a first date, amount, last word, or name of at most four words; the trimmed value itself where nothing is found, the dash for none."""
    v = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    if field.endswith("_date"):
        out = F.coalesce(_found(v, FIRST_DATE), v)
    elif field == "total_amount":
        out = F.coalesce(F.trim(_found(v, FIRST_AMOUNT)), _found(v, FIRST_NUMBER), v)
    elif field == "invoice_number":
        out = F.coalesce(F.try_element_at(_words(v), F.lit(-1)), v)
    else:
        bare = lambda t: F.btrim(F.lower(t), F.lit(":.,-"))
        w, stops = _words(v), "^(?:" + "|".join(FIRST_STOPS) + ")"
        before = lambda found, among: F.coalesce(F.nullif(F.array_position(F.transform(among, found), True), F.lit(0)) - 1, F.size(among)).cast("int")
        rest = F.slice(w, before(lambda t: ~bare(t).isin(FIRST_LABELS), w) + 1, F.greatest(F.size(w), F.lit(1)))
        kept = F.slice(rest, 1, F.least(before(lambda t: bare(t).rlike(stops) | bare(t).rlike("^[0-9]+$"), rest), F.lit(most)))
        out = F.when(F.size(kept) > 0, F.btrim(F.array_join(kept, " "), F.lit(",:. "))).otherwise(v)
    return F.when(F.coalesce(raw, F.lit("")).isin("", "—"), "—").otherwise(out)
