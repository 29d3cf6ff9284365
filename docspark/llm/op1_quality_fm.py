r"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The features of a text are its words and their shapes, hashed into BUCKETS and L2-normalised counts; statistics of its
structure (word and line lengths, repeats, capitals, symbols, digits, punctuation); and the metadata column n_chars. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),

all pairwise interactions of rank FACTORS in time linear in the features that a text has. It is fitted by AdaGrad on the
driver, on features (not texts) of at most `max_train` labelled rows, taken in order of a hash of the id; every whole text is
scored, in Arrow batches, with the model as a broadcast of fixed size. No shuffle.

Cases: a null or empty text is scored by its (empty) features. Null n_chars reads as the text's length. A null id is not
held out and never trained on; of several labels of an id the mean decides, a tie is left out. Without labels, or with one
class only, the score is the constant share of label 1, and 0.5 without any. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, labels

BUCKETS, FACTORS, MAX_TRAIN = 1 << 16, 8, 6000
DENSE = 14
SYMBOLS = "#*$%&|<>{}[]\\^~@_="
CACHE = 300_000
_SHAPE = (re.compile("[^\\W\\d_a-z]+"), re.compile("[^\\W\\d_A]+"), re.compile("\\d+"))
_UPPER, _DIGIT, _PUNCT = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"


def shape(word: str) -> str:
    """Runs of capitals, of other letters and of digits shrink to one sign each, runs of one other character to one."""
    s = re.sub(r"[A-Z]+", "A", word)
    s = _SHAPE[2].sub("0", _SHAPE[1].sub("a", s))
    return re.sub(r"(.)\1+", r"\1", s)


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % BUCKETS


def dense(text: str, n_chars: int | None, words: list[str], counts: Counter) -> list[float]:
    n, size, raw = max(1, len(words)), max(1, len(text)), text.encode("utf-8", "replace")
    lines = [x for x in text.split("\n") if x]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        np.log1p(len(words)) / 5,
        np.log1p(len(text) if n_chars is None else max(0, n_chars)) / 5,
        (len(text) - len(words)) / n / 5,
        len(counts) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 3,
        np.log1p(len(words) / max(1, len(lines))) / 3,
        3 * gone(_UPPER) / size,
        5 * sum(map(text.count, SYMBOLS)) / size,
        5 * gone(_DIGIT) / size,
        5 * gone(_PUNCT) / size,
        10 * raw.count(b"!") / size,
        10 * raw.count(b"|") / size,
        max(counts.values(), default=0) / n,
    ]


class Features:
    """Makes features in one Python worker; words are looked up in a cache of bounded size."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}

    def of(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Indices (hashed, then dense), values."""
        text = text or ""
        words = text.split()
        counts = Counter(words)
        found = list(map(self.cache.get, counts))
        if None in found:
            if len(self.cache) > CACHE:
                self.cache.clear()
            for i, w in enumerate(counts):
                if found[i] is None:
                    found[i] = self.cache[w] = (_bucket("w" + w.lower()), _bucket("s" + shape(w)))
        c = np.fromiter(counts.values(), np.float32, len(counts))
        both = np.array(found, np.int64).reshape(-1, 2)
        shapes, at = np.unique(both[:, 1], return_inverse=True)
        s = np.bincount(at, weights=c, minlength=len(shapes)).astype(np.float32)
        norm = lambda x: x / max(1e-9, float(np.sqrt((x * x).sum())))
        return np.concatenate([both[:, 0], shapes]), np.concatenate([norm(np.sqrt(c)), norm(s)]).astype(np.float32), dense(text, n_chars, words, counts)


class FactorisationMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    @classmethod
    def constant(cls, share: float) -> FactorisationMachine:
        share = min(1 - 1e-6, max(1e-6, share))
        n = BUCKETS + DENSE
        return cls(float(np.log(share / (1 - share))), np.zeros(n, np.float32), np.zeros((n, FACTORS), np.float32), np.zeros(DENSE), np.ones(DENSE))

    def rows(self, rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices and values of all rows one after the other, and where each begins."""
        d = np.clip((np.array([r[2] for r in rows]) - self.mean) / self.scale, -4, 4).astype(np.float32)
        tail = np.arange(BUCKETS, BUCKETS + DENSE)
        ix = np.concatenate([x for r in rows for x in (r[0], tail)])
        x = np.concatenate([x for r, e in zip(rows, d, strict=True) for x in (r[1], e)])
        return ix, x, np.concatenate([[0], np.cumsum([len(r[0]) + DENSE for r in rows])[:-1]])

    def margin(self, ix: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ix] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        return self.w0 + np.add.reduceat(self.w[ix] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1), sums, vx

    def score(self, rows: list[tuple]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(rows))[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple], y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, AdaGrad, batches of 64 rows in an order fixed by the seed."""
    if len(y) == 0 or y.min() == y.max():
        return FactorisationMachine.constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    d = np.array([r[2] for r in rows])
    m = FactorisationMachine.constant(float(y.mean()))
    m.mean, m.scale = d.mean(0), d.std(0) + 1e-3
    m.v = rng.normal(0, 0.05, m.v.shape).astype(np.float32)
    gw, gv, g0 = np.full(m.w.shape, 1e-6, np.float32), np.full(m.v.shape, 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            ix, x, starts = m.rows([rows[i] for i in part])
            z, sums, vx = m.margin(ix, x, starts)
            lengths = np.diff(np.append(starts, len(ix)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32) / len(part)
            e = np.repeat(err, lengths)
            u, back = np.unique(ix, return_inverse=True)
            order_ = np.argsort(back, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(back))[:-1]])
            dw = np.add.reduceat((e * x)[order_], cuts) + decay * m.w[u]
            dv = np.add.reduceat((e[:, None] * (x[:, None] * np.repeat(sums, lengths, axis=0) - x[:, None] * vx))[order_], cuts) + decay * m.v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            g0 += float(err.sum()) ** 2
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
            m.w0 -= rate * float(err.sum()) / np.sqrt(g0)
    return m


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_ids(known: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, y of at most max_train labelled rows that are not held out, by a hash of the id."""
    per = known.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q <> 0.5")
    return per.select("doc_id", (F.col("q") > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def train(docs: DataFrame, known: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """docs: doc_id, text, n_chars. The sample of ids has a bound, so it is broadcast; of rows that share an id one is used, by a hash of its text, so the bound holds for rows."""
    ids = F.broadcast(training_ids(known, max_train))
    own = docs.select("doc_id", "n_chars", F.xxhash64("text", "n_chars").alias("h")).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("h").alias("h"))
    sample = docs.select("doc_id", "text", "n_chars", F.xxhash64("text", "n_chars").alias("h")).join(F.broadcast(own), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "n_chars", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for b in batches:
            f = [made.of(*r) for r in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.string()), pa.array([r[0].astype(np.int32) for r in f], pa.list_(pa.int32())), pa.array([r[1] for r in f], pa.list_(pa.float32())), pa.array([r[2] for r in f], pa.list_(pa.float64())), b.column("y")],
                names=["id", "ix", "x", "d", "y"],
            )

    got = sample.mapInArrow(run, "id string, ix array<int>, x array<float>, d array<double>, y int").toArrow()
    got = got.take(pa.compute.sort_indices(got, [("id", "ascending")])) if len(got) else got
    lists = [[np.asarray(v.values) for v in got.column(c)] for c in ("ix", "x", "d")]
    return fit([(a.astype(np.int64), b, list(c)) for a, b, c in zip(*lists, strict=True)], np.asarray(got.column("y"), np.float32))


def score(docs: DataFrame, model: FactorisationMachine, out: str = "score") -> DataFrame:
    """doc_id and the score of every row of docs (doc_id, text, n_chars)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, m = Features(), sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = m.score([made.of(*r) for r in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", out])

    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {out} double")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held out or not, score and prediction."""
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
