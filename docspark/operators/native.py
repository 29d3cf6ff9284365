"""Invoice fields from the text of a native PDF: for each field patterns in order of trust, some over several lines, and a scan of the lines of a table whose headers stand in lines of their own. All of it is expressions over one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import stripped
from docspark.operators.features import let

# Forms of dates, and the patterns of each field in their order. Group 1 is the value.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\s+\d{{4}}"
NUMBER = (
    r"invoice\s*(?:no\.?|number|#|num\.?)\s*:?\s+([A-Z0-9#][A-Z0-9#\-/]+)",
    r"INVOICE\s+#\s+([A-Z0-9][A-Z0-9\-]+)",
    r"^INVOICE\s+(\d{4,})",
    r"^invoice\s+(?:no\.?\s+)?(\d{3,})",
)
INVOICE_DATE = (
    rf"(?:invoice\s+)?date\s*:?\s*\n?\s*({DATE})",
    rf"(?:issued?|created)\s*:?\s*({DATE})",
    rf"^({DATE})\s*\n\s*invoice",
)
DUE_DATE = (
    rf"due[\s\-]date\s*:?\s*({DATE})",
    rf"payment\s+due\s*:?\s*({DATE})",
    rf"total\s+due\s+by\s*[^\n]*?({DATE})",
    rf"pay(?:able)?\s+(?:by|on)\s*:?\s*({DATE})",
)
ORDER_TABLE = rf"order\s+date\s*\n+order\s+number\s*\n+due\s+date\s*\n+({DATE})\s*\n+\S+\s*\n+({DATE})"
RECIPIENT = (
    r"bill\s+to\s*:?\s*\n\s*(.+)",
    r"billed\s+to\s*:?\s*\n\s*(.+)",
    r"ship\s+to\s*:?\s*\n\s*([A-Z][^\n]{1,50})",
    r"^to\s*\n\s*([A-Z][^\n]{1,50})",
)
_CODE = r"(?:\s*(?:EUR|USD|GBP|CAD|AUD|CHF))?"
TOTAL = (
    rf"total\s+due\s+by[^\n]*\n\s*(\d[\d,\.]+){_CODE}",
    rf"total\s+due\s*:?\s*\n?\s*(\d[\d,\.]+){_CODE}",
    rf"amount\s+due\s*:?\s*\n?\s*(\d[\d,\.]+){_CODE}",
    rf"grand\s+total\s*:?\s*\$?\s*(\d[\d,\.]+){_CODE}",
    rf"\btotal\b\s*\**\s*\$?\s*(\d[\d,\.]+){_CODE}",
    rf"balance\s+due\s*:?\s*(\d[\d,\.]+){_CODE}",
    rf"total\s+due\s*\n\s*(\d[\d,\.]+){_CODE}",
)
CURRENCY = r"\b(?:EUR|USD|GBP|CAD|AUD)\b|[$€£]"
LABEL_LINE = r"^(?:tel|fax|phone|email|web|http|www|invoice|date|lorem|we\s|order|ship|bill|to\b|from\b|due|total|sub)"
PHONE_LINE = r"^\+?\d[\d\s\-().]{5,}$"
HEADERS = ("to", "ship to")
#: Characters on either side of a total among which a currency is looked for; lines among which the issuer is.
AROUND, TOP = 20, 20
#: Case is ignored, ^ and $ are ends of lines, only \n ends a line, classes hold all scripts.
_FLAGS = "(?imdU)"


def _matches(x: Column, pattern: str) -> Column:
    return x.rlike(f"{_FLAGS}(?:{pattern})")


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(x, _FLAGS + pattern, group), F.lit(""))


def _found(x: Column, patterns: Sequence[str], ok=lambda v: F.lit(True)) -> Column:
    """Of each pattern's first match the first value that is ok."""
    values = [stripped(_first(x, p)) for p in patterns]
    return F.coalesce(*[F.when(v.isNotNull() & ok(v), v) for v in values])


def _table(lines: Column) -> Column:
    """struct(date, name) below the first line `Date` of which the headers of a table of three columns follow; null without."""
    n = F.size(lines)
    low = lambda i: F.lower(F.get(lines, i))
    head = F.array_position(F.transform(lines, lambda x, i: (F.lower(x) == "date") & (i + 3 < n)), F.lit(True)).cast("int") - 1

    def below(h: Column) -> Column:
        there = (h >= 0) & (low(h + 1).isin(*HEADERS) | low(h + 2).isin(*HEADERS))
        dated = F.filter(F.sequence(h + 2, F.least(h + 4, n - 1)), lambda j: _matches(F.get(lines, j), f"^(?:{DATE})"))
        at = F.get(dated, F.lit(0))
        name = F.get(lines, at + 1)
        good = (name != "") & ~F.lower(name).contains("same as") & ~F.lower(name).isin(*HEADERS, "none") & ~name.rlike(r"(?U)^\d+\s+[A-Z]") & (F.length(name) < 60)
        return F.when(there & at.isNotNull(), F.struct(F.get(lines, at).alias("date"), F.when(good, name).alias("name")))

    return let(head, lambda h: F.when(h >= 0, below(h)))


def _issuer(lines: Column) -> Column:
    """The first of the top lines that is no label, number, address, phone or web address, and not long."""

    def plain(x: Column) -> Column:
        low = F.lower(x)
        return (x != "") & ~_matches(x, LABEL_LINE) & ~_matches(x, PHONE_LINE) & ~x.contains("@") & ~low.startswith("http") & ~x.rlike(r"(?U)^\d") & (F.length(x) <= 60)

    return F.get(F.filter(F.slice(lines, 1, TOP), plain), F.lit(0))


def _total(text: Column) -> Column:
    """The first pattern's amount that is 1 or more and not like the day and month of a date, with the currency around it."""
    each = []
    for p in TOTAL:
        raw = F.regexp_replace(_first(text, p), r"[.,]+$", "")
        value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
        like_date = raw.rlike(r"^\d{1,2}\.\d{2}$") & (value < 50)
        at, width = F.regexp_instr(text, F.lit(_FLAGS + p)), F.length(_first(text, p, 0))
        start = F.greatest(at - AROUND, F.lit(1))
        sign = F.upper(_first(F.substring(text, start, at + width + AROUND - start), CURRENCY, 0))
        code = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP").otherwise(sign)
        each.append(F.when((value >= 1) & ~like_date, F.concat_ws(" ", raw, code)))
    return F.coalesce(*each)


def native_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the six fields as columns, null where nothing is found; a null text has none. The due date is never the invoice date by label; a table of order and due date gives what is still missing."""
    clash = {"_text", "_lines", "_table", "_order"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    t = F.col("_text")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_lines", F.transform(F.split(t, "\n"), lambda x: stripped(x)))
    labelled = _found(t, INVOICE_DATE)
    df = df.withColumn("invoice_date", labelled)
    df = df.withColumn("_table", F.when(F.col("invoice_date").isNull(), _table(F.col("_lines"))))
    df = df.withColumn("invoice_date", F.coalesce("invoice_date", F.col("_table.date")))
    due = _found(t, DUE_DATE, lambda v: ~v.eqNullSafe(F.col("invoice_date")))
    df = df.withColumn("due_date", due).withColumn("_order", F.when(F.col("due_date").isNull(), F.struct(_first(t, ORDER_TABLE, 1).alias("date"), _first(t, ORDER_TABLE, 2).alias("due"))))
    df = df.withColumn("invoice_date", F.coalesce("invoice_date", F.col("_order.date"))).withColumn("due_date", F.coalesce("due_date", F.col("_order.due")))
    person = lambda v: ~v.rlike(r"(?U)^\d+\s+[A-Z]") & ~v.contains("@") & ~F.lower(v).contains("same as") & ~F.lower(v).isin("ship to", "bill to", "to", "none") & (F.length(v) < 60)
    df = df.withColumns(
        {
            "invoice_number": _found(t, NUMBER, lambda v: v.rlike(r"(?U)\d")),
            "issuer_name": _issuer(F.col("_lines")),
            "recipient_name": F.coalesce(F.col("_table.name"), _found(t, RECIPIENT, person)),
            "total_amount": _total(t),
        }
    )
    return df.drop("_text", "_lines", "_table", "_order")
