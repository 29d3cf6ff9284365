"""Corrections of extracted invoice fields by the words of their document: confidence gate, dates that are missing or swapped, and the business rules. Column expressions over an array of words; a missing field is an empty string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import DASH
from docspark.operators import cleaning
from docspark.operators.cleaning import ADDRESS_WORDS
from docspark.operators.selection import invoice_number

# Least confidences by field, what a date and an amount look like in running text, labels of dates and of totals.
THRESHOLDS = {"invoice_number": 0.70, "invoice_date": 0.70, "due_date": 0.70, "issuer_name": 0.95, "recipient_name": 0.50, "total_amount": 0.70}
DATE = r"(?i)\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{1,2}[-/][A-Za-z]{3,9}[-/]\d{2,4}\b|\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
AMOUNT = r"(?i)[$€£¥₹₩]\s*\d[\d,.\s]*\d|\d[\d,.\s]*\d\s*(?:USD|EUR|GBP|CAD|AUD|CHF)|\d{1,3}(?:[,]\d{3})*\.\d{2}"
TOTAL = r"(?i)(?:total|balance\s+due|amount\s+due|grand\s+total)\s*:?\s*([$€£¥₹₩]?\s*\d[\d,.\s]*\d)"
DUE_LABELS = ("due", "payment", "pay", "payable", "expiry", "deadline")
DUE_LABELS_OF_CLEANER = (*DUE_LABELS, "expires")
ISSUE_LABELS = ("invoice", "issued", "issue", "created", "date")
CODE = r"\b[A-Z0-9][A-Z0-9/\-]{2,}\b"
FRAGMENT, FRAGMENT_MOST = r"^\d{1,2}\.\d{2}$", 31.12
NUMBER_FRAGMENT = r"^\d+-\d+/\d+$"
NAME_CHARS, NAME_TOKENS = 60, 6


def gate(df: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """df (a string column and a column <field>_conf for each field): a value stays if its confidence reaches its threshold, else it is empty; so is an issuer with confidence 0. Confidences get four decimals; null counts as 0."""
    conf = lambda f: F.coalesce(F.col(f"{f}_conf"), F.lit(0.0))
    keep = {f: F.when((conf(f) >= least) & ~((F.lit(f) == "issuer_name") & (conf(f) == 0)), F.coalesce(f, F.lit(""))).otherwise("") for f, least in thresholds.items()}
    return df.withColumns(keep | {f"{f}_conf": F.round(conf(f), 4) for f in thresholds})


def _mentions(plain: Column, start: Column, end: Column, labels: Sequence[str]) -> Column:
    """Whether a label occurs in the words from start to before end."""
    from_ = F.greatest(start, F.lit(0))
    return F.array_join(F.slice(plain, from_ + 1, end - from_), " ").rlike("|".join(labels))


def _date(x: Column) -> Column:
    return F.btrim(F.regexp_extract(x, DATE, 0))


def _prepared(df: DataFrame, words: str) -> DataFrame:
    """df with _words, _plain (lower case, no punctuation at the ends), _date (the first date in each word, or empty) and _hits, an array of (pos, date). Columns, so that what runs over a word's neighbours doesn't make them again."""
    df = df.withColumn("_words", F.coalesce(F.col(words), F.array().cast("array<string>")))
    df = df.withColumns({"_plain": F.transform("_words", lambda w: F.btrim(F.lower(w), F.lit(":.,-"))), "_date": F.transform("_words", _date)})
    return df.withColumn("_hits", F.filter(F.transform("_date", lambda x, i: F.struct(i.alias("pos"), x.alias("date"))), lambda x: x["date"] != ""))


PREPARED = ("_words", "_plain", "_date", "_hits")


def _first(a: Column, then: str | None = None) -> Column:
    x = F.get(a, F.lit(0))
    return x if then is None else x[then]


def fallback_dates(df: DataFrame, words: str = "words") -> DataFrame:
    """df with invoice_date and due_date, an empty one being taken from a date within four words after a word, whose neighbours have the label; one value never fills both, and where both labels stand the due date comes first. Null words and dates count as empty."""
    df = _prepared(df, words)
    before = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.when(x["pos"] > 0, F.sequence(F.greatest(x["pos"] - 4, F.lit(0)), x["pos"] - 1)).otherwise(F.array().cast("array<int>"))))))

    def at(i: Column) -> Column:
        ahead = F.filter(F.slice("_date", i + 2, 4), lambda x: x != "")
        return F.struct(_first(ahead).alias("date"), _mentions(F.col("_plain"), i - 1, i + 2, DUE_LABELS_OF_CLEANER).alias("due"), _mentions(F.col("_plain"), i - 1, i + 2, ISSUE_LABELS).alias("issue"))

    start = F.struct(F.coalesce("invoice_date", F.lit("")).alias("invoice_date"), F.coalesce("due_date", F.lit("")).alias("due_date"))

    def step(a: Column, x: Column) -> Column:
        due = (a["due_date"] == "") & x["due"] & (x["date"] != a["invoice_date"])
        issue = ~due & (a["invoice_date"] == "") & x["issue"] & (x["date"] != a["due_date"])
        return F.struct(F.when(issue, x["date"]).otherwise(a["invoice_date"]).alias("invoice_date"), F.when(due, x["date"]).otherwise(a["due_date"]).alias("due_date"))

    df = df.withColumn("_filled", F.aggregate(F.transform(before, at), start, step))
    return df.withColumns({c: F.col(f"_filled.{c}") for c in ("invoice_date", "due_date")}).drop("_filled", *PREPARED)


def arbitrate_dates(df: DataFrame, words: str = "words") -> DataFrame:
    """df with invoice_date and due_date: if just one is filled and two words or more have dates, the other is the first different one near its own label, or away from the other's label, or else the first different one. Null words and dates count as empty."""
    df = _prepared(df, words).withColumns({c: F.coalesce(c, F.lit("")) for c in ("invoice_date", "due_date")})
    issue, due = F.col("invoice_date"), F.col("due_date")
    df = df.withColumn("_other", F.filter("_hits", lambda x: x["date"] != F.concat(issue, due)))  # one of them is empty
    near = lambda labels: lambda x: _mentions(F.col("_plain"), x["pos"] - 5, x["pos"] + 2, labels)
    is_due, is_issue = near(DUE_LABELS_OF_CLEANER), near(ISSUE_LABELS)
    best = lambda own, foreign: F.coalesce(_first(F.filter("_other", lambda x: own(x) | ~foreign(x)), "date"), _first(F.col("_other"), "date"), F.lit(""))
    act = (F.size("_hits") >= 2) & ((issue == "") != (due == ""))
    return df.withColumns({"invoice_date": F.when(act & (issue == ""), best(is_issue, is_due)).otherwise(issue), "due_date": F.when(act & (due == ""), best(is_due, is_issue)).otherwise(due)}).drop("_other", *PREPARED)


def _number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^\d.,]", ""), ",", "").try_cast("double")


def _short_name(x: Column) -> Column:
    """The first words of a name, before any that is an address of mail or web."""
    tokens = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    contact = lambda t: t.contains("@") | F.lower(t).startswith("http") | F.lower(t).startswith("www")
    stop = _first(F.filter(F.transform(tokens, lambda t, i: F.when(contact(t), i)), lambda i: i.isNotNull()))
    return F.btrim(F.array_join(F.slice(tokens, 1, F.least(F.lit(NAME_TOKENS), F.coalesce(stop, F.size(tokens)))), " "), F.lit(",.:-() "))


def validate_and_correct(df: DataFrame, words: str = "words", notes: str = "validation_notes") -> DataFrame:
    """df (six string fields and an array of words) with the rules applied in turn, and an array of the rules that acted.
    RULE1: equal dates are assigned anew, by labels near them or in their order. RULE2: a total that is no number, or looks like a day and month, is replaced by the first amount of at least 1. RULE3: the invoice number is selected among candidates (a dash if none is left). RULEX: a due date that looks like a piece of a number goes. RULE4: names with an address of mail or web, or of more than 60 characters, are cut. RULE5: missing dates and totals are looked for behind their labels.
    Null fields and words count as empty."""
    df = _prepared(df, words).withColumn("_text", F.array_join("_words", " "))
    w, text, plain = F.col("_words"), F.col("_text"), F.col("_plain")
    trimmed = lambda c: F.btrim(F.col(c))
    df = df.withColumns({f: F.coalesce(f, F.lit("")) for f in THRESHOLDS}).withColumn(notes, F.array().cast("array<string>"))

    def act(df: DataFrame, rule: str, when: Column, **new: Column) -> DataFrame:
        return df.withColumns({f: F.when(when, x).otherwise(F.col(f)) for f, x in new.items()} | {notes: F.when(when, F.array_append(notes, F.lit(rule))).otherwise(F.col(notes))})

    # the first place of each date, in order of places
    df = df.withColumn("_sorted", F.array_sort(F.transform("_hits", lambda x: F.struct(x["date"].alias("date"), x["pos"].alias("pos")))))
    firsts = F.filter("_sorted", lambda x, i: (i == 0) | (F.get(F.col("_sorted"), i - 1)["date"] != x["date"]))
    df = df.withColumn("_once", F.array_sort(F.transform(firsts, lambda x: F.struct(x["pos"].alias("pos"), x["date"].alias("date")))))
    df = df.withColumn("_unique", F.array_distinct(F.concat(F.transform("_once", lambda x: x["date"]), F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda x: F.btrim(x)))))
    unique = F.col("_unique")
    near = lambda labels: _first(F.filter("_once", lambda x: _mentions(plain, x["pos"] - 5, x["pos"] + 2, labels)), "date")
    both = near(ISSUE_LABELS).isNotNull() & near(DUE_LABELS).isNotNull()
    equal = (trimmed("invoice_date") != "") & (trimmed("invoice_date") == trimmed("due_date"))
    df = act(df, "RULE1", equal, invoice_date=F.when(F.size(unique) < 2, F.col("invoice_date")).when(both, near(ISSUE_LABELS)).otherwise(F.get(unique, F.lit(0))), due_date=F.when(F.size(unique) < 2, F.col("due_date")).when(both, near(DUE_LABELS)).otherwise(F.get(unique, F.lit(1))))

    total = trimmed("total_amount")
    fragment = F.regexp_replace(total, r"[^\d.,]", "").rlike(FRAGMENT) & (_number(total) <= FRAGMENT_MOST)
    amount = F.btrim(F.regexp_extract(text, AMOUNT, 0))
    bad = ~total.isin("", DASH) & (_number(total).isNull() | fragment)
    df = act(df, "RULE2", bad, total_amount=F.when(_number(amount) >= 1, amount).otherwise(""))

    before = trimmed("invoice_number")
    labelled = F.create_map(F.lit("invoice_number"), before, F.lit("due_date"), F.col("due_date"), F.lit("invoice_date"), F.col("invoice_date"))
    df = df.withColumn("_number", invoice_number(before, text, labelled, F.regexp_extract_all(text, F.lit(CODE), F.lit(0))))
    df = act(df, "RULE3", F.coalesce(F.nullif(before, F.lit("")), F.lit(DASH)) != F.col("_number")).withColumn("invoice_number", F.col("_number")).drop("_number")
    df = act(df, "RULEX", trimmed("due_date").rlike(NUMBER_FRAGMENT), due_date=F.lit(""))
    for f in ("issuer_name", "recipient_name"):
        low = F.lower(trimmed(f))
        contact = low.contains("@") | low.contains("http") | low.contains("www.")
        df = act(df, f"RULE4 {f}", contact | (F.length(low) > NAME_CHARS), **{f: _short_name(F.col(f))})

    behind = lambda labels: F.filter(F.transform(F.filter(F.transform(plain, lambda x, i: F.when(x.isin(*labels), i)), lambda i: i.isNotNull()), lambda i: _date(F.array_join(F.slice(w, i + 1, 6), " "))), lambda x: x != "")
    issue = _first(behind(ISSUE_LABELS))
    df = act(df, "RULE5 invoice_date", (F.col("invoice_date") == "") & issue.isNotNull(), invoice_date=issue)
    due = _first(F.filter(behind(DUE_LABELS), lambda x: x != F.col("invoice_date")))
    df = act(df, "RULE5 due_date", (F.col("due_date") == "") & due.isNotNull(), due_date=due)
    found = F.btrim(F.regexp_extract(text, TOTAL, 1))
    df = act(df, "RULE5 total_amount", (F.col("total_amount") == "") & F.coalesce(_number(found) >= 1, F.lit(False)), total_amount=found)
    return df.drop("_text", "_sorted", "_once", "_unique", *PREPARED)


# Words before the "to" that leads to a recipient.
TO_TRIGGERS = ("bill", "billed", "sold", "send", "ship")
NAME_WINDOW = 6


def fallback_recipient(df: DataFrame, words: str = "words", most: int = NAME_TOKENS) -> DataFrame:
    """df with recipient_name, an empty one being taken from the words behind the first "bill to" (or the like) that a name follows; a word joined to the "to" counts. A name ends before an address word, a number, or an address of mail or web. Null names and words count as empty."""
    w, name = F.coalesce(F.col(words), F.array().cast("array<string>")), F.coalesce("recipient_name", F.lit(""))
    bare = lambda t: F.btrim(t, F.lit(":.,-"))
    stops = lambda t: F.lower(t).rlike("^(?:" + "|".join(ADDRESS_WORDS) + "|http)") | t.rlike(r"^\d+$") | t.contains("@")
    df = df.withColumn("_words", w)

    def parts(i: Column) -> Column:
        head = F.filter(F.array(F.regexp_replace(F.get(F.col("_words"), i + 1), r"(?i)^to[:\s]*", "")), lambda t: t != "")
        rest = F.filter(F.transform(F.slice("_words", i + 3, NAME_WINDOW), bare), lambda t: t != "")
        end = F.coalesce(_first(F.filter(F.transform(rest, lambda t, j: F.when(stops(t), j)), lambda j: j.isNotNull())), F.size(rest))
        return F.concat(head, F.slice(rest, 1, F.greatest(F.least(end, most - F.size(head)), F.lit(0))))

    places = F.filter(F.transform("_words", lambda t, i: F.when(bare(F.lower(t)).isin(*TO_TRIGGERS) & F.lower(F.get(F.col("_words"), i + 1)).startswith("to"), i)), lambda i: i.isNotNull())
    found = F.btrim(F.array_join(_first(F.filter(F.transform(places, parts), lambda p: F.size(p) > 0)), " "), F.lit(",:. "))
    return df.withColumn("recipient_name", F.when(name == "", F.coalesce(found, F.lit(""))).otherwise(name)).drop("_words")


def clean_fields(df: DataFrame, words: str = "words") -> DataFrame:
    """df (six string fields and an array of words) with each field cleaned, then recipient and dates filled from the words."""
    kinds = {"invoice_number": cleaning.invoice_number, "invoice_date": cleaning.date, "due_date": cleaning.date, "issuer_name": cleaning.name, "recipient_name": cleaning.name, "total_amount": cleaning.amount}
    df = df.withColumns({f: clean(F.trim(F.coalesce(f, F.lit("")))) for f, clean in kinds.items()})
    return arbitrate_dates(fallback_dates(fallback_recipient(df, words), words), words)
