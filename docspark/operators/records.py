"""Records for training and truth for evaluation: fields of annotations, fields of tags, words and boxes of a document up to a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.numeric import box
from docspark.functions.text import stripped
from docspark.operators.evaluation import FIELDS

# The keys of each field in an annotation, the first that has text counting, and what is read of its text.
KEYS = {
    "invoice_number": ("NUMBER",),
    "invoice_date": ("DATE",),
    "due_date": ("DUE_DATE",),
    "issuer_name": ("SELLER_NAME",),
    "recipient_name": ("BUYER", "BILL_TO", "SEND_TO"),
    "total_amount": ("TOTAL", "AMOUNT_DUE"),
}
NUMBER_VALUE = r"(?i)(?:INVOICE\s*(?:#|ID|NUMBER|NO\.?)\s*|Invoice\s+(?:number|no\.?)\s*)[:\s]*(.+)"
DAY = r"\d{1,2}-[A-Za-z]{3}-\d{4}"
AFTER_COLON = r"[:\s]+(\S.+?)\s*$"
RECIPIENT_LABEL = r"(?i)^(?:Bill\s+to\s*:?\s*|Buyer\s*:?\s*|SHIP\s+TO\s*:?\s*|SEND\s+TO\s*:?\s*|TO\s*:?\s*)"
AMOUNT_END = r"([\d,]+(?:\.\d+)?\s*(?:USD|EUR|GBP|INR|AUD|CAD|\$|€|£)?)\s*$"
DIGITS_END = r"[:\s]+(\d[\d,. ]*)\s*$"
#: Words of a record, and the word and box that stand for a document without words.
MOST_WORDS, NOTHING, NOTHING_BOX = 256, "empty", (0, 0, 1, 1)


def _text(fields: Column, field: str) -> Column:
    """The text of the first key that has some."""
    return F.coalesce(*[F.nullif(stripped(F.try_element_at(fields, F.lit(k))), F.lit("")) for k in KEYS[field]])


def _group(x: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def annotated_fields(df: DataFrame, fields: str = "fields") -> DataFrame:
    """df with the six fields as columns, read from a map of annotation keys to texts: of the first line, without its label; null for keys without text and for a null map."""
    text = {f: _text(F.col(fields), f) for f in FIELDS}
    line = lambda f: stripped(F.get(F.split(text[f], r"\r\n|[\n\r]"), F.lit(0)))
    day = lambda f: F.coalesce(_group(text[f], DAY, 0), stripped(_group(line(f), AFTER_COLON)), line(f))
    name = stripped(F.regexp_replace(line("recipient_name"), RECIPIENT_LABEL, ""))
    made = {
        "invoice_number": F.coalesce(stripped(_group(line("invoice_number"), NUMBER_VALUE)), line("invoice_number")),
        "invoice_date": day("invoice_date"),
        "due_date": day("due_date"),
        "issuer_name": line("issuer_name"),
        "recipient_name": F.coalesce(F.nullif(name, F.lit("")), line("recipient_name")),
        "total_amount": F.coalesce(stripped(_group(line("total_amount"), AMOUNT_END)), stripped(_group(line("total_amount"), DIGITS_END)), line("total_amount")),
    }
    return df.withColumns(made)


def tagged_fields(tokens: DataFrame) -> DataFrame:
    """doc_id, field, text of tags (doc_id, pos, word, tag): all words of a field in order, whatever stands between them."""
    words = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("")).alias("word"))))
    own = tokens.filter("tag <> 'O'").groupBy("doc_id", F.substring("tag", 3, 1 << 20).alias("field"))
    return own.agg(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"))


def dataset_records(documents: DataFrame, words: DataFrame, width: Column, height: Column, most: int = MOST_WORDS) -> DataFrame:
    """documents with arrays words and boxes (thousandths of the page): the first `most` words with text of each document, or one word that says that there are none. words: doc_id, word_id, text, left, top, width, height; a page without size counts as one pixel."""
    w, h = F.greatest(F.coalesce(width, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(height, F.lit(1)), F.lit(1))
    clean = stripped(F.coalesce("text", F.lit("")))
    at = box(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"), w, h)
    kept = words.withColumn("_t", clean).filter("_t <> ''")
    lists = kept.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("word_id", F.col("_t").alias("text"), at.alias("box")))), 1, most).alias("_w"))
    df = documents.join(lists, "doc_id", "left")
    texts = F.coalesce(F.transform("_w", lambda x: x["text"]), F.array(F.lit(NOTHING)))
    boxes = F.coalesce(F.transform("_w", lambda x: x["box"]), F.array(F.array(*map(F.lit, NOTHING_BOX))))
    return df.select(*documents.columns, texts.alias("words"), boxes.alias("boxes"))
