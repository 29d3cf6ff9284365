r"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch is a table of changes: an insert adds a document's count, a delete subtracts it, a revision adds new minus old.
Totals are sums, so a batch is first summed by key (map-side, a hot source combines to one row a task) and only those sums
are stored, one folder per batch. The folder's _SUCCESS marker is the commit: a batch that is committed is not applied
again, one that was cut off is overwritten by its next attempt. Totals add up the base and all batches committed since;
`compact` folds batches into a new base whose marker names them, in one step that can be repeated, and deletes what it replaces.

Tokens are those of real vocabularies, each a tokenizer version with totals of its own: byte-pair ranks from files, whose
content goes to the tasks as a broadcast. `counted` adds the counts of texts in Arrow batches, whole texts, no shuffle.

Cases: null source or language are keys of their own. A null text counts zero tokens but one document. Null counts count
as zero. Rows that repeat count as often as they stand there; other columns are not read. Totals without documents and tokens are left out. Empty batches commit and change nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import delete, documents, exists, fresh, labels, new_path, stored, text_of
from docspark.llm.op10_bpe import PATTERN

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions: vocabulary files by name.
VERSIONS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
SPACES = " \t\n\x0b\x0c\r"


class TokenRollup:
    """Totals under `path`."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _committed(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x for x in names if exists(self.spark, f"{self.path}/{x}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (KEYS, docs, tokens; both signed) as batch `batch`; False if that was committed before."""
        if not batch.replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits and _")
        if any(x == f"batch={batch}" or x.startswith("base=") and batch in self._folded(x) for x in self._committed()):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum(F.coalesce("docs", F.lit(0))).cast("long").alias("n_docs"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _folded(self, base: str) -> set[str]:
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/batches").collect()}

    def _parts(self) -> tuple[list[str], set[str]]:
        """The folders that make up the totals, and the batches in the base. A base is whole when its own marker is there, which is written last."""
        names = self._committed()
        bases = [x for x in names if x.startswith("base=")]
        folded = self._folded(bases[-1]) if bases else set()
        return [f"{b}/totals" for b in bases[-1:]] + [x for x in names if x.startswith("batch=") and x[6:] not in folded], folded

    def totals(self) -> DataFrame:
        parts, _ = self._parts()
        read = self.spark.read.schema(self.SCHEMA)
        rows = read.parquet(*[f"{self.path}/{x}" for x in parts]) if parts else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        parts, folded = self._parts()
        n = max([int(x[5:]) + 1 for x in self._committed() if x.startswith("base=")], default=0)
        at = f"{self.path}/base={n:08d}"
        self.totals().write.mode("overwrite").parquet(f"{at}/totals")
        batches = sorted(folded | {x[6:] for x in parts if x.startswith("batch=")})
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{at}/batches")
        old = [x for x in self._committed() if x.startswith("base=")] + [f"batch={b}" for b in batches]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(marker, True).close()
        for x in old:  # the new base holds their sums and names
            delete(self.spark, f"{self.path}/{x}")


def default_vocabularies() -> dict[str, str]:
    """Tokenizer version: path of its file."""
    import public_tokenizers

    return {name.split(".")[0]: public_tokenizers.path(name) for name in VERSIONS}


_LOADED: dict[str, tiktoken.Encoding] = {}


def _encoding(name: str, content: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of this Python worker, built once."""
    if name not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _LOADED[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[name]


def counted(docs: DataFrame, vocabularies: dict[str, str], text: str = "text") -> DataFrame:
    """docs without its text, with a struct column `tokens` of counts by tokenizer version (as many as there are vocabularies) at its end."""
    contents = {}
    for name, path in vocabularies.items():
        with open(path, "rb") as f:
            contents[name] = f.read()
    sent, at = docs.sparkSession.sparkContext.broadcast(contents), docs.columns.index(text)
    keep, (out,) = [c for c in range(len(docs.columns)) if c != at], fresh(docs, "tokens")
    names = [*[docs.columns[i] for i in keep], out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = [_encoding(name, content, PATTERN) for name, content in sent.value.items()]
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            counts = [pa.array([len(e.encode_ordinary(t)) for t in texts], pa.int64()) for e in encodings]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.StructArray.from_arrays(counts, list(contents))], names=names)

    fields = [docs.schema[i] for i in keep]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StructType([T.StructField(n, T.LongType()) for n in contents]))]))


def signed(rows: DataFrame, sign: int, **tokens: Column) -> DataFrame:
    """Changes that insert (1) or delete (-1) each row, with a count for every tokenizer version."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tokenizer"), c.alias("tokens")) for k, c in tokens.items()]))
    return rows.withColumn("x", each).select("source", "lang", "x.tokenizer", F.lit(sign).cast("long").alias("docs"), (F.col("x.tokens") * sign).alias("tokens"))


def revised(rows: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    return rows.filter(~old.eqNullSafe(new)).select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).alias("tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive; then texts with white space at their ends are revised to the texts without, toxic documents are taken down, and two batches are sent again, to no effect."""
    vocabularies = default_vocabularies()
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", text_of("text").alias("text"))
    docs = stored(counted(docs.withColumn("spaced", F.col("text") != F.btrim("text", F.lit(SPACES))), vocabularies), "counts")
    spaced = documents(spark, sf_dir).select("source", "lang", "doc_id", F.btrim(text_of("text"), F.lit(SPACES)).alias("text"), text_of("text").alias("was")).filter("text <> was").drop("was")
    after = stored(counted(spaced, vocabularies), "revised")
    one = lambda rows, sign: signed(rows, sign, **{v: F.col("tokens")[v] for v in vocabularies})
    toxic = labels(spark, sf_dir).filter("toxic = 1").select("doc_id").distinct()
    revise = one(after, 1).unionByName(one(docs.filter("spaced"), -1))
    delete_ = one(docs.filter("NOT spaced").unionByName(after, allowMissingColumns=True).join(toxic, "doc_id", "left_semi"), -1)
    for batch, changes in (("arrive", one(docs, 1)), ("revise", revise), ("arrive", one(docs, 1)), ("delete", delete_)):
        rollup.commit(batch, changes)
    rollup.compact()
    rollup.commit("delete", delete_)
    return rollup.totals()
