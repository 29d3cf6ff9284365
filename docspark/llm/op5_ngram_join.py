r"""N-gram Jaccard join by T-occurrence search.

Two documents link when the Jaccard similarity of their sets of k-word shingles is at least t. A query set of n shingles and
one of m link exactly if T = ceil(t / (1 + t) * (n + m)) of the query's inverted lists hold the other document. DivideSkip
sorts the lists by length, sets the L < T longest aside, merges the short ones through a heap, and looks for documents found
at least T - L times in the long lists by binary probes, stopping when T can't be reached any more.

Distributed, the shortest lists are those of a document's rarest shingles, n - ceil(t n) + 1 of them: every link shares one.
Only these are shuffled, as (shingle, document) rows; rarity is read from a table of counts per hash bucket over all documents.
Of equal sets one stands for all (copies are never paired). First neighbours in the lists are searched, and the links found
are merged to components; then, list by list, pairs of documents of different components, each at the first shingle that they share and seldom again.
A pair goes to the search only if lossless bounds, by the place of that shingle and by bitmaps of the sets, allow T; the texts of these documents are read from the input again. In the search
the candidates of a query, in blocks, form inverted lists; short ones are merged, long ones probed. Links between documents that are connected
already are not looked for; components are exact all the same.

Cases: a null text, or one without words, has an empty set and is linked with nothing. Fewer than k words are one shingle.
Rows with equal ids are rows of their own; a null id counts only where a component has no other. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import documents, stored, stored_alone
from docspark.llm.components import connected_components
from docspark.llm.op8_exact_dedup import bit_filter, let_through

#: The contract's: shingles of three words, similarity in percent.
K, PERCENT = 3, 90
SKETCH = 1 << 18
#: Longs of the bitmap that goes with the lists; of the second one that sets above WIDE_FROM shingles have, by their size.
BITMAP_LONGS = 8
WIDE_FROM = 512
#: Shingles of a set that go with each of its rows in the lists, to tell whether a pair has met before.
BEFORE = 4
#: Bytes of text that are hashed at once (more for a longer word), documents and candidates in a block.
SPAN, DOCUMENTS, CANDIDATES = 1 << 20, 1000, 512
MU = 0.0085
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: A number for each byte; words are hashed as polynomials over these in an odd base, modulo 2**64.
_OF_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BASE = 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY[0]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLY[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """64-bit hashes of the shingles of many texts at once."""

    def __init__(self, k: int):
        self.k, self.up, self.down = k, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            m = 2 * len(self.up)
            step = [np.uint64(pow(b, len(self.up), 1 << 64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            self.up, self.down = (np.concatenate([x, x * s])[:m] for x, s in zip((self.up, self.down), step, strict=True))

    def _words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words low[start:end]."""
        out, at = np.zeros(len(starts), np.uint64), 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + SPAN, "right")))
            self._powers(int(ends[to - 1] - base))
            span = low[base : ends[to - 1]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[span] * self.up[: len(span)])])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = _mixed((sums[e] - sums[s]) * self.down[s])
            at = to
        return out

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hash at each place of each text, repeats included, and where each text's begin (with the end at last)."""
        texts = texts.fill_null("").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        in_word, edges = ~_SPACE[data], at[:-1][at[:-1] < at[1:]]
        before, after = np.concatenate([[False], in_word[:-1]]), np.concatenate([in_word[1:], [False]])
        if len(data):
            before[edges], after[at[1:][at[:-1] < at[1:]] - 1] = False, False
            starts, ends = np.flatnonzero(in_word & ~before), np.flatnonzero(in_word & ~after) + 1
        else:
            starts = ends = np.zeros(0, np.int64)
        h, first = self._words(_FOLD[data], starts, ends), np.searchsorted(starts, at)
        n = np.diff(first)
        # a text of fewer than k words is one shingle
        count = np.where(n >= self.k, n - self.k + 1, np.minimum(n, 1))
        begin = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(n)), count)
        place = first[row] + np.arange(begin[-1]) - begin[row]
        length = np.minimum(n, self.k)[row]
        s = length.astype(np.uint64)
        for i in range(self.k):
            on = length > i
            s[on] = _mixed(s[on] * _MULTIPLY[1] + h[place[on] + i])
        return s, begin


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which a link shares at least one, in any order common to all sets."""
    return n + (-percent * n // 100) + 1 if n else 0


def occurrences(n: int, m: int, percent: int) -> int:
    """T: the overlap that sets of n and m need."""
    return -(-percent * (n + m) // (100 + percent))


class InvertedLists:
    """For each shingle of some sets the positions of the sets that have it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        shingle, self.sizes = np.concatenate([np.zeros(0, np.uint64), *sets]), [len(s) for s in sets]
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.document = shingle[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def of(self, query: np.ndarray) -> list[list[int]]:
        """The lists of a query's shingles, the longest first."""
        starts, ends = np.searchsorted(self.shingle, query), np.searchsorted(self.shingle, query, "right")
        return [self.document[starts[i] : ends[i]].tolist() for i in np.argsort(starts - ends, kind="stable")]


def merge_short(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(position, number of lists that have it), in order, through a heap."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    last, count = -1, 0
    while heap:
        d, i, j = heap[0]
        if j + 1 < len(lists[i]):
            heapq.heapreplace(heap, (lists[i][j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if d != last:
            if count:
                yield last, count
            last, count = d, 0
        count += 1
    if count:
        yield last, count


def divide_skip(query: np.ndarray, index: InvertedLists, percent: int) -> list[int]:
    """Positions of the sets that reach the required overlap with the query. No overlap is known before short lists are merged and long ones probed."""
    n = len(query)
    if not n or not index.sizes:
        return []
    need, lists = [occurrences(n, m, percent) for m in index.sizes], index.of(query)
    t = max(1, min(need))
    skip = max(0, min(t - 1, int(t / (MU * np.log2(max(1, len(lists[0])) + 1) + 1))))
    found, probes = [], lists[:skip]
    for d, have in merge_short(lists[skip:]):
        left = skip
        for p in probes:
            if have >= need[d] or have + left < need[d]:
                break
            left -= 1
            have += (j := bisect_left(p, d)) < len(p) and p[j] == d
        if have >= need[d]:
            found.append(d)
    return found


def _sketch(docs: DataFrame, k: int, size: int) -> np.ndarray:
    """Shingles per bucket of their hashes (size: a power of two), over all documents. One array of fixed size for each task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = Shingler(k), np.zeros(size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, DOCUMENTS):
                s, _ = made.shingles(b.column("text").slice(at, DOCUMENTS))
                total += np.bincount((s & np.uint64(size - 1)).view(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int32)
    out[np.asarray(rows.column("bucket"))] = np.minimum(np.asarray(rows.column("n")), 2**31 - 1)
    return out


def bitmap(s: np.ndarray, longs: int = BITMAP_LONGS) -> list[int]:
    """Bit b is the parity of the shingles that hash to b: sets that differ in d shingles differ in at most d bits."""
    bits = np.bincount(((s >> np.uint64(20)) & np.uint64(64 * longs - 1)).view(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _name(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _read(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, key (hash of the text), n, fp (128 bits: names the set), prefix (rarest shingles), bits, wide."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counts = Shingler(k), sent.value
        for b in batches:
            for at in range(0, b.num_rows, DOCUMENTS):
                part, rows = b.slice(at, DOCUMENTS), []
                hashes, begin = made.shingles(part.column("text"))
                for i in range(part.num_rows):
                    s = np.unique(hashes[begin[i] : begin[i + 1]])
                    if not len(s):
                        rows.append((0, None, [], None, None))
                        continue
                    rare = counts[(s & np.uint64(len(counts) - 1)).view(np.int64)]
                    rarest = s[np.argsort(rare, kind="stable")[: prefix_length(len(s), percent)]].view(np.int64)  # s is sorted, so ties go by hash
                    rows.append((len(s), _name(s), rarest, bitmap(s), bitmap(s, wide_longs(len(s))) if len(s) > WIDE_FROM else None))
                n, fp, prefix, bits, wide = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "fp", "prefix", "bits", "wide"]
                )

    rows = docs.select("doc_id", key_of("text").alias("key"), "text")
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("key long, n long, fp binary, prefix array<long>, bits array<long>, wide array<long>").fields]))


def wide_longs(n: int) -> int:
    """A bit for every two shingles or so; sizes of one power of four share a width."""
    return 1 << (2 * ((n // 64).bit_length() // 2) + 1)


def key_of(text: str) -> Column:
    """64 bits that name a text; where two texts share them, the class's own text is told by the fingerprint of its set."""
    return F.xxhash64(text)


def _need(percent: int) -> Column:
    """The overlap that sets of na and nb shingles need."""
    return F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - 1e-9)


def _possible(percent: int) -> Column:
    """Whether bitmaps xa and xb (of one width) of sets of na and nb shingles allow the overlap that they need."""
    differ = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return differ <= F.col("na") + F.col("nb") - 2 * _need(percent)


def _search(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes the links. Each query's candidates come to its task in a stream behind its own row; texts are read again, of those classes only that the bitmaps let through."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    names = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "asked")
    wide = classes.select("sid", "n", "wide").filter("wide IS NOT NULL").join(names, "sid", "left_semi")
    side = lambda p: wide.withColumnsRenamed({"sid": p, "n": f"n{p}", "wide": f"x{p}"})
    x = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    left = stored(x.filter(F.when(F.size("xa") == F.size("xb"), _possible(percent)).otherwise(F.lit(True))).select("a", "b"), "pairs")
    # the text of each class that is left, once for every query that asks for it
    asked = left.unionByName(left.select("a", F.col("a").alias("b")).distinct())
    names = stored(asked.select(F.col("b").alias("sid")).distinct().join(classes.select("sid", "key", "fp"), "sid"), "asked")
    held = docs.select("text").withColumn("key", key_of("text")).filter(let_through(bit_filter(names.select("key")), F.col("key")))
    texts = stored(held.join(names, "key").select(F.col("sid").alias("b"), "fp", "text").groupBy("b", "fp", F.xxhash64(F.lit(1), "text").alias("other_key")).agg(F.min("text").alias("text")).drop("other_key"), "texts")
    rows = asked.join(texts, "b").select("a", (F.col("a") != F.col("b")).alias("other"), "b", "fp", "text")
    rows = rows.repartition("a").sortWithinPartitions("a", "other", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(k)
        name, query, names, sets = None, None, [], []

        def flush() -> pa.RecordBatch:
            hit = divide_skip(query, InvertedLists(sets), percent)
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.int64()), pa.array([names[i] for i in hit], pa.int64())], names=["a", "b"])
            names.clear()
            sets.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                hashes, begin = made.shingles(part.column("text"))
                for i, (a, other, b, fp) in enumerate(zip(*[part.column(c).to_pylist() for c in ("a", "other", "b", "fp")], strict=True)):
                    s = np.unique(hashes[begin[i] : begin[i + 1]])
                    if _name(s) != fp:  # another text that shares the class's hash
                        continue
                    if not other:
                        if names:
                            yield flush()
                        name, query = a, s
                    else:
                        names.append(b)
                        sets.append(s)
                        if len(names) == CANDIDATES:
                            yield flush()
        if names:
            yield flush()

    return rows.mapInArrow(run, "a long, b long")


def _labelled(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Lists (s, sid, n, i: place of s in the order of the set) that hold more than one component, with the component c, and `before`: up to BEFORE such shingles of the set ahead of s."""
    w = W.partitionBy("s")
    rows = shared.join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("s", "sid", "n", "i", F.coalesce("component", "sid").alias("c"))
    rows = rows.withColumn("lo", F.min("c").over(w)).withColumn("hi", F.max("c").over(w)).filter("lo <> hi").select("s", "sid", "n", "i", "c")
    return rows.withColumn("before", F.collect_list("s").over(W.partitionBy("sid").orderBy("i").rowsBetween(-BEFORE, -1)))


def _met(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in a list that are of different components and may link. The first shingle that both sets have bounds what they share by what follows
    it in each; a list is skipped for a pair if one of the shingles just before is common too, since the pair has met there. Its first list is never skipped."""
    x = labelled.select("s", F.col("sid").alias("a"), F.col("n").alias("nb"), F.col("c").alias("ca"), F.col("i").alias("ia"), F.col("before").alias("ea"), F.col("bits").alias("xa"))
    y = labelled.select("s", F.col("sid").alias("b"), F.col("n").alias("na"), F.col("c").alias("cb"), F.col("i").alias("ib"), F.col("before").alias("eb"), F.col("bits").alias("xb"))
    later = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("b") < F.col("a"))
    near = F.col("na") * 100 >= F.col("nb") * percent
    follow = F.least(F.col("nb") - F.col("ia"), F.col("na") - F.col("ib")) >= _need(percent)
    on = (x["s"] == y["s"]) & (F.col("ca") != F.col("cb")) & later & near & follow & ~F.arrays_overlap("ea", "eb") & _possible(percent)
    return x.join(y, on).select("a", "b")


def ngram_components(docs: DataFrame, k: int = K, percent: int = PERCENT, sketch_size: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, fp (equal for equal sets) for every row of docs (doc_id, text)."""
    return stored_alone(docs.sparkSession, lambda: _components(docs.select("doc_id", "text"), k, percent, sketch_size), "components")


def _components(docs: DataFrame, k: int, percent: int, sketch_size: int) -> DataFrame:
    spark = docs.sparkSession
    read = stored(_read(docs, k, percent, _sketch(docs, k, sketch_size)), "sets")
    # of equal sets one stands for all: the combiner keeps one row of a set in each task
    classes = read.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("key", "n", "prefix", "bits", "wide")])
    classes = stored(classes.withColumn("sid", F.monotonically_increasing_id()), "classes")
    lists = classes.select("sid", "n", F.posexplode("prefix").alias("i", "s"))
    shared = stored(lists.withColumn("c", F.count("*").over(W.partitionBy("s"))).filter("c > 1").select("s", "sid", "n", "i"), "lists")
    near = F.col("na") * 100 >= F.col("nb") * percent
    w = W.partitionBy("s").orderBy("n", "sid")
    chain = shared.select(F.lag("sid").over(w).alias("b"), F.lag("n").over(w).alias("na"), F.col("sid").alias("a"), F.col("n").alias("nb")).filter("b IS NOT NULL").filter(near)
    bits = classes.select("sid", "bits")
    chain = chain.distinct().join(bits.select(F.col("sid").alias("a"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("sid").alias("b"), F.col("bits").alias("xb")), "b").filter(_possible(percent))
    chain = stored(chain.select("a", "b"), "chain")
    first = stored_alone(spark, lambda: _search(chain, classes, docs, k, percent), "links")
    parts = stored_alone(spark, lambda: connected_components(first), "parts")
    labelled = stored(_labelled(shared, parts).join(bits, "sid"), "lists")
    rest = _met(labelled, percent).distinct().join(chain, ["a", "b"], "left_anti")
    edges = stored_alone(spark, lambda: first.unionByName(_search(rest, classes, docs, k, percent)), "links")
    parts = stored_alone(spark, lambda: connected_components(edges), "parts")
    named = classes.select("sid", "fp", "least").join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("fp", "least", F.coalesce("component", "sid").alias("c"))
    named = stored(named, "named")
    names = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id")
    out = read.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(names, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "fp")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its set and smallest document that links reach."""
    return ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
