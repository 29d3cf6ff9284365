"""The operators as stages of a corpus pipeline: tables of documents in, tables of documents out. Rows are followed by a row number that is stored with them, so null or repeated ids lose nothing; columns pass through whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import fresh, stored, stored_alone
from docspark.llm.op2_line_dedup import line_dedup
from docspark.llm.op3_mixing import mix
from docspark.llm.op4_quality_rules import quality_rules
from docspark.llm.op5_ngram_join import ngram_components
from docspark.llm.op10_bpe import default_tokenizer, digests, round_trip

#: Near duplicates: shingles of five words, similarity in percent.
SHINGLE, SIMILAR = 5, 80


def _numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs as a stored table with row numbers, and names free in it, the row number's first."""
    taken = fresh(docs, "_row", *names)
    return stored(docs.withColumn(taken[0], F.monotonically_increasing_id()), "numbered"), taken


def _named(table: DataFrame, row: str) -> DataFrame:
    """doc_id (a struct that orders rows: null ids last, then by id, then by row), source, text."""
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    return table.select(name.alias("doc_id"), *[c for c in ("source", "text") if c in table.columns])


def keep_good(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents that the quality rules keep: null, empty and short texts go, an empty table stays empty, repeated rows are judged alike."""
    return quality_rules(docs, known)


def drop_lines(docs: DataFrame) -> DataFrame:
    """Documents without the removed lines; n_chars, where there is one, follows. A document of which no word is left goes."""
    gone, _ = fresh(docs, "removed_lines", "total_lines")
    out = line_dedup(docs).filter((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    count: Column = F.when(F.col(gone) == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long") if "n_chars" in docs.columns else F.lit(None)
    return out.select(*[count.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """Of each component of links the document with the smallest id stays, and every document without words."""
    table, (row,) = _numbered(docs)
    parts = ngram_components(_named(table, row), k, percent)
    gone = parts.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.row").alias(row))
    return table.join(gone, row, "left_anti").select(*docs.columns)


def mix_sources(docs: DataFrame) -> DataFrame:
    """Each document once for every pass of the schedule that takes half of its words or more, written in the order of the schedule's slots. Documents without words go; repeated rows and null ids are rows of their own."""
    table, (row, slot) = _numbered(docs, "_slot")

    def taken() -> DataFrame:
        _, pieces = mix(_named(table, row))
        passes = pieces.groupBy("doc_id", "size", "pass").agg(F.sum("length").alias("n"), F.min("slot").alias(slot)).filter("2 * n >= size")
        return passes.select(F.col("doc_id.row").alias(row), slot)

    copies = stored_alone(docs.sparkSession, taken, "copies")
    return table.join(copies, row).orderBy(slot, row).select(*docs.columns)


def tokens(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The columns of docs but the text, then ids, n_tokens, and digests of the ids and of the text that they decode to (names that are taken get underscores)."""
    others = [c for c in docs.columns if c != "text"]
    ids, n, a, b = fresh(docs, "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    coded = round_trip(docs, tokenizer_path or default_tokenizer())
    made = digests(*coded.columns[-2:])
    return coded.select(*others, F.col(coded.columns[-2]).alias(ids), *[c.alias(x) for c, x in zip(made, (n, a, b), strict=True)])
