r"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language: scores of its affixes, character n-grams and lexicon entry (words frequent in training
have a weight of their own), plus learned transitions between the languages of neighbouring words; forward-backward gives
the probability of each language at each word. So code-switched texts get word labels (`label_words`), and a text gets the
language with the most probability over its words, that mean being the score (`identify`).

Training: at most PER_LANGUAGE texts with CHARACTERS characters of each of the MAX_LANGUAGES languages with most rows, taken by a
hash of the id from rows that are not held out; the texts are whole, very long ones are not in the sample. A language beyond
that number is not learned, and never predicted. They are cut into segments, and segments of different languages are chained, so that transitions are learned;
AdaGrad on the driver, on the exact gradient from forward-backward. The model has a fixed size and is broadcast.

Prediction: one pass, no shuffle. Scores of words are kept in a cache of bounded size. Chains are cut into blocks of BLOCK
words; products of a block's transfer matrices carry messages over blocks, then all blocks run side by side. That is exact
forward-backward for a text of any length.

Cases: a null text or one without a letter is `und` with score 0 and has no words. A null id is not held out. Without labelled
texts all predictions are `und`; with one language all are that one. Repeated rows are labelled one by one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import documents

HASHED, LEXICON = 1 << 15, 2000
PER_LANGUAGE, BLOCK, CHAIN = 300, 64, 48
#: At most this many languages can be learned.
MAX_LANGUAGES = 200
#: Characters of a language's sample.
CHARACTERS = 2_000_000
CACHE = 300_000
#: Feature texts of a kind whose indices are kept, and scores added up at once for words that are not in the cache.
NAMES, SCORES = 400_000, 1 << 21
WORDS_AT_ONCE = 400_000
UND = "und"
#: Runs of letters with the marks that follow them.
WORD = regex.compile(r"(?:\p{L}\p{M}*+)++")


class _Hashed(dict):
    """Index of a feature by its text; the kind of feature is hashed before the text. Emptied when it has NAMES entries."""

    def __init__(self, kind: str):
        super().__init__()
        self.start = zlib.crc32(kind.encode())

    def __missing__(self, text: str) -> int:
        if len(self) >= NAMES:
            self.clear()
        found = self[text] = zlib.crc32(text.encode("utf-8", "replace"), self.start) % HASHED
        return found


BIAS, PREFIX, SUFFIX, GRAM = (_Hashed(kind) for kind in ("bias", "p", "s", "n"))


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Indices: a bias, affixes, n-grams with word ends, and the lexicon entry after the hashed ones. Each text counts once of its kind, in the order of the word."""
    b = f"<{word}>"
    grams = dict.fromkeys([*[b[i : i + 2] for i in range(len(b) - 1)], *[b[i : i + 3] for i in range(len(b) - 2)]])
    prefixes, suffixes = dict.fromkeys((word[:1], word[:2], word[:3])), dict.fromkeys((word[-1:], word[-2:], word[-3:], word[-4:]))
    out = [BIAS[""], *map(PREFIX.__getitem__, prefixes), *map(SUFFIX.__getitem__, suffixes), *map(GRAM.__getitem__, grams)]
    if word in lexicon:
        out.append(HASHED + lexicon[word])
    return out


class LanguageCRF:
    def __init__(self, languages: list[str], lexicon: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.lexicon, self.weights, self.transitions = languages, lexicon, weights, transitions
        self.cache: dict[str, int] = {}
        self.table = np.zeros((1024, len(languages)))

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "lexicon": self.lexicon, "weights": self.weights, "transitions": self.transitions, "cache": {}, "table": self.table[:1024]}

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the scores of each word, the largest 1. The cache is emptied between calls only."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        self._learn([w for w in dict.fromkeys(words) if w not in self.cache])
        return self.table[list(map(self.cache.__getitem__, words))]

    def _learn(self, words: list[str]) -> None:
        """Adds different words to the cache and their rows to the table, as many at once as SCORES allows."""
        at = len(self.cache)
        self.cache.update(zip(words, range(at, at + len(words)), strict=True))
        if (more := at + len(words) - len(self.table)) > 0:
            self.table = np.concatenate([self.table, np.zeros((max(more, len(self.table)), self.table.shape[1]))])
        most, flat, starts = SCORES // max(1, self.table.shape[1]), [], []
        for i, w in enumerate(words):
            starts.append(len(flat))
            flat += word_features(w, self.lexicon)
            if len(flat) >= most or i + 1 == len(words):
                s = np.add.reduceat(self.weights[flat], starts)
                self.table[at : at + len(starts)] = np.exp(s - s.max(1, keepdims=True))
                at, flat, starts = at + len(starts), [], []

    def posteriors(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities of languages at each word: e has the emissions of chains of these lengths, one after the other."""
        return chain_posteriors(e, lengths, np.exp(self.transitions))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def chain_posteriors(e: np.ndarray, lengths: np.ndarray, a: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Forward-backward by blocks. A chain starts from a uniform state before its first word."""
    n, k = e.shape
    per = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(per)])
    nb = int(first[-1])
    # blocks by falling length: those that have a word at a place are the first ones
    size = np.full(nb, block)
    size[first[1:][per > 0] - 1] = (lengths - (per - 1) * block)[per > 0]
    place = np.empty(nb, dtype=np.int64)
    place[np.argsort(-size, kind="stable")] = np.arange(nb)
    have = [int((size > i).sum()) for i in range(block)]
    row = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    b, t = place[first[row] + inside // block], inside % block
    filled = np.ones((block, nb, k))
    filled[t, b] = e
    # the product of each block's transfer matrices; beyond a chain's end nothing changes
    p = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for i in range(block):
        m = have[i]
        q = (p[:m].reshape(-1, k) @ a).reshape(-1, k, k) * filled[i, :m, None, :]
        np.divide(q, np.maximum(q.sum((1, 2), keepdims=True), 1e-300), out=p[:m])
    into, out = np.full((nb, k), 1.0 / k), np.full((nb, k), 1.0 / k)
    for j in range(1, int(per.max(initial=0))):
        at = first[:-1][per > j] + j
        into[place[at]] = _scaled(np.einsum("bi,bij->bj", into[place[at - 1]], p[place[at - 1]]))
        back = first[1:][per > j] - 1 - j
        out[place[back]] = _scaled(np.einsum("bij,bj->bi", p[place[back + 1]], out[place[back + 1]]))
    forward, state = np.empty((block, nb, k)), into
    for i in range(block):
        m = have[i]
        state[:m] = _scaled((state[:m] @ a) * filled[i, :m])
        forward[i, :m] = state[:m]
    state = out
    for i in range(block - 1, -1, -1):
        m = have[i]
        forward[i, :m] *= state[:m]
        state[:m] = _scaled((filled[i, :m] * state[:m]) @ a.T)
    return _scaled(forward[t, b])


def fit(texts: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, seed: int = 11) -> LanguageCRF:
    """texts: (language, text). Each epoch chains segments of the texts anew."""
    languages = sorted({x for x, _ in texts})
    counts, spans = Counter(), []
    for lang, text in texts:
        words = [w.lower() for w in WORD.findall(text)]
        counts.update(words)
        spans.append((languages.index(lang), words))
    lexicon = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])}
    k = len(languages)
    m = LanguageCRF(languages, lexicon, np.zeros((HASHED + LEXICON, k)), np.zeros((k, k)))
    if k < 2:
        return m
    vocab = {w: i for i, w in enumerate(counts)}
    feats = [np.array(word_features(w, lexicon)) for w in vocab]
    gw, gt = np.full(m.weights.shape, 1e-2), np.full((k, k), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        segments = []
        for lang, words in spans:
            at = 0
            while at < len(words):
                step = int(rng.integers(4, 40))
                segments.append((lang, words[at : at + step]))
                at += step
        order = rng.permutation(len(segments))
        ids = np.concatenate([[vocab[w] for w in segments[i][1]] for i in order])
        tags = np.concatenate([np.full(len(segments[i][1]), segments[i][0]) for i in order])
        rows = -(-len(ids) // CHAIN)  # the last chain is filled up from the epoch's start
        ids, tags = (np.resize(x, rows * CHAIN).reshape(rows, CHAIN) for x in (ids, tags))
        for at in range(0, rows, 128):
            _step(m, ids[at : at + 128], tags[at : at + 128], feats, gw, gt, rate)
    return m


def _step(m: LanguageCRF, ids: np.ndarray, tags: np.ndarray, feats: list[np.ndarray], gw: np.ndarray, gt: np.ndarray, rate: float) -> None:
    """One step on the exact gradient: what is observed less what is expected."""
    k = len(m.languages)
    u, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape)
    f = np.concatenate([feats[i] for i in u])
    ends = np.cumsum([len(feats[i]) for i in u])
    starts = np.concatenate([[0], ends[:-1]])
    s = np.add.reduceat(m.weights[f], starts)
    e = np.exp(s - s.max(1, keepdims=True))[at]
    a = np.exp(m.transitions)
    n, t, _ = e.shape
    fw, bw = np.empty_like(e), np.ones_like(e)
    fw[:, 0] = _scaled((np.full((n, k), 1.0 / k) @ a) * e[:, 0])
    for i in range(1, t):
        fw[:, i] = _scaled((fw[:, i - 1] @ a) * e[:, i])
    for i in range(t - 2, -1, -1):
        bw[:, i] = _scaled((e[:, i + 1] * bw[:, i + 1]) @ a.T)
    post = _scaled(fw * bw)
    pairs = fw[:, :-1, :, None] * a * (e[:, 1:] * bw[:, 1:])[:, :, None, :]
    pairs /= np.maximum(pairs.sum((2, 3), keepdims=True), 1e-300)
    seen = np.eye(k)[tags]
    dt = (np.einsum("nti,ntj->ij", seen[:, :-1], seen[:, 1:]) - pairs.sum((0, 1))) / n
    dword = np.zeros((len(u), k))
    np.add.at(dword, at.ravel(), (seen - post).reshape(-1, k) / n)
    each = np.repeat(dword, np.diff(np.append(starts, ends[-1])), axis=0)
    fu, back = np.unique(f, return_inverse=True)
    dw = np.stack([np.bincount(back, weights=each[:, j], minlength=len(fu)) for j in range(k)], 1) - 1e-4 * m.weights[fu]
    gw[fu] += dw**2
    gt += dt**2
    m.weights[fu] += rate * dw / np.sqrt(gw[fu])
    m.transitions += rate * dt / np.sqrt(gt)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, characters: int = CHARACTERS) -> LanguageCRF:
    """docs: doc_id, text, lang. Ids of the sample are chosen first, then their texts fetched: of each of the MAX_LANGUAGES languages with most rows (by name where equal) the first rows by a hash of the id, at most per_language, as long as they have no more than `characters` together. A text of more than a twentieth of that is not in the sample."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.length("text") <= characters // 20))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    first = W.partitionBy("lang").orderBy(*order)
    languages = [r.lang for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()]
    # short rows choose: a row is named by id, language and text; repeated ones are taken once
    short = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    chosen = usable.filter(F.col("lang").isin(languages)).select("doc_id", "lang", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    chosen = chosen.withColumn("r", F.row_number().over(short)).filter(F.col("r") <= per_language)
    chosen = chosen.withColumn("n", F.sum("n").over(short.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("n") <= characters)
    rows = usable.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen.select("doc_id", "lang", "h").distinct()), ["doc_id", "lang", "h"])
    rows = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).select("doc_id", "lang", "text").collect()
    return fit([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))])


def _marked(model: LanguageCRF, texts: list[str | None]) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """For groups of texts of about WORDS_AT_ONCE words: first and last text, all words, lengths, posteriors."""
    at, words, lengths = 0, [], []
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower()) if t else []
        words += found
        lengths.append(len(found))
        if len(words) >= WORDS_AT_ONCE or i + 1 == len(texts):
            n = np.array(lengths)
            post = model.posteriors(model.emissions(words), n) if words and model.languages else np.zeros((len(words), max(1, len(model.languages))))
            yield at, i + 1, words, n, post
            at, words, lengths = i + 1, [], []


def identify(docs: DataFrame, model: LanguageCRF) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for a, z, _, n, post in _marked(m, b.column("text").to_pylist()):
                total = np.zeros((len(n), post.shape[1]))
                if full := np.flatnonzero(n).size:
                    at = np.flatnonzero(n)
                    total[at] = np.add.reduceat(post, (np.cumsum(n) - n)[at]) / n[at, None]
                best = total.argmax(1)
                known = (n > 0) & bool(m.languages) & bool(full)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, z - a), pa.array([m.languages[i] if ok else UND for i, ok in zip(best, known, strict=True)]), pa.array(np.where(known, np.clip(total.max(1), 0, 1), 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def label_words(docs: DataFrame, model: LanguageCRF) -> DataFrame:
    """doc_id and words (array of word, lang, p) for every row of docs: the most probable language at each word."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for a, z, words, n, post in _marked(m, b.column("text").to_pylist()):
                best = post.argmax(1)
                tags = [m.languages[i] for i in best] if m.languages else [UND] * len(words)
                flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(tags, pa.string()), pa.array(post.max(1) if len(post) else [], pa.float64())], ["word", "lang", "p"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)], names=["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, words array<struct<word string, lang string, p double>>")


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held out or not, predicted language and score."""
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
