r"""Periodic runs of words by the algorithm of Kolpakov and Kucherov, text by text, in Arrow batches without a shuffle.

The words of a text, as numbers, are cut into Lempel-Ziv factors: from the left, each factor is a word not seen before or the
longest stretch that also starts earlier. A suffix automaton whose states know where they first end gives factors and earlier
occurrences in one walk. A run that is not strictly inside a factor touches the border before the factor that it ends in, or the
border it ends at; at each border the longest common extensions of Main's algorithm (two Z functions over the two factors
around it) give all of these: one that ends in factor j starts less than a period before factor j - 1, or that factor would
have been longer. Runs strictly inside a factor are copied from the factor's earlier occurrence, left to right, so that copies
are copied on. Time and memory are linear in the words and the runs.

Of a run of `least` words or more with two full periods, every `least / 2` words stand a period apart a second time in the run.
So words that no repeated window of that many words covers are in no run: they end a stretch, and the algorithm runs on each
stretch of covered words. Windows are compared by hashes; a clash only covers more.

Collapsing keeps a run's first period: a word goes when it is in a run behind that.

Cases: null and empty texts and texts without words have no runs and collapse to an empty text; a text of one word has none.
Ties, nested and overlapping runs are all returned, each once with its smallest period. Repeated rows and ids, null ids and
further columns pass through; an added column whose name exists gets underscores behind its own, and stands last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import documents, fresh, text_of, words_of

LEAST = 12
#: Bytes of text in a batch that goes back to the JVM.
BATCH = 1 << 22


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, distance back to an earlier occurrence; 0 for a symbol not seen before) of the Lempel-Ziv factors."""
    step, link, size, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(x):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                link[q] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    out, at, n = [], 0, len(x)
    while at < n:
        state, end = 0, at
        while end < n and first[to := step[state][x[end]]] < end:
            state = to
            end += 1
        if end == at:
            out.append((at, at + 1, 0))
            at += 1
        else:
            out.append((at, end, end - 1 - first[state]))
            at = end
    return out


def common_prefixes(x: list[int]) -> list[int]:
    """Z function: the longest common prefix of x and each of its suffixes; the whole length at 0."""
    n, left, right = len(x), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(x: list[int], low: int, border: int, high: int, periods: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of maximal repetitions of x that touch the border, seen from low to high, with periods below `periods`, smallest first. Those that go on outside are left to another border."""
    before, behind = border - low, high - border
    right, window = x[border:high], x[low:high]
    z = common_prefixes([*right, -1, *window])
    mirror = common_prefixes([*window[:before][::-1], -1, *window[::-1]])
    n = len(x)
    for p in range(1, periods):
        for start, end in (
            (border - mirror[before + 1 + behind - p], border + p + z[p] if p < behind else high) if p <= behind else (0, 0),
            (border - p - (mirror[p] if p < before else 0), border + z[behind + 1 + before - p]) if p <= before else (0, 0),
        ):
            if end - start >= least and end - start >= 2 * p and (start == 0 or x[start - 1] != x[start - 1 + p]) and (end == n or x[end] != x[end - p]):
                yield start, end, p


def runs(x: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` symbols, by start, then period. Symbols are not negative."""
    cut = factors(x)
    found: dict[tuple[int, int], int] = {}
    for j, (start, end, _) in enumerate([*cut, (len(x), len(x), 0)]):
        if j == 0:
            continue
        last, own = start - cut[j - 1][0], end - start
        low = max(0, start - 2 * last - own)
        for s, e, p in at_border(x, low, start, end, last + own + 1, least):
            if found.get((s, e), p) >= p:
                found[s, e] = p
    starting: dict[int, list[tuple[int, int]]] = {}
    for (s, e), p in sorted(found.items()):
        starting.setdefault(s, []).append((e, p))
    for start, end, back in cut:
        if back:
            for s in range(start + 1, end - least):
                inner = [(e + back, p) for e, p in starting.get(s - back, ()) if e + back < end]
                if inner:  # what starts here already touches a border behind, so that it is longer
                    starting[s] = inner + starting.get(s, [])
    return sorted((s, e - s, p) for s, ends in starting.items() for e, p in ends)


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of stretches of words that repeated windows of least / 2 words cover, of `least` words or more."""
    k = least // 2
    n = len(ids) - k + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = (h ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return []
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + k, -1)
    ends = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])))
    return [(int(a), int(b)) for a, b in zip(ends[::2], ends[1::2], strict=True) if b - a >= least]


def text_runs(text: bytes, least: int = LEAST) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text's words, and the kept words joined by one space."""
    words = text.split()  # ASCII white space, as bytes are split
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    found = [(a + s, n, p) for a, b in stretches(ids, least) for s, n, p in runs(ids[a:b].tolist(), least)] if len(seen) < len(words) else []
    if not found:
        return [], b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int32)
    for s, n, p in found:
        edge[s + p] += 1
        edge[s + n] -= 1
    dropped = np.cumsum(edge[:-1]) > 0
    return found, b" ".join([w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone])


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, runs_as: str = "runs", collapsed_as: str = "collapsed") -> DataFrame:
    """df with two columns at its end: array<struct<start, length, period>> of the runs, by start, then period, and the collapsed text."""
    names, at = fresh(df, runs_as, collapsed_as), df.columns.index(text)
    parts = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = total = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
            for i, n in enumerate(sizes):
                total += n
                if total < BATCH and i < len(sizes) - 1:
                    continue
                part = batch.slice(start, i + 1 - start)
                made = [text_runs(t or b"", least) for t in part.column(at).cast(pa.binary()).to_pylist()]
                flat = np.array([r for found, _ in made for r in found], np.int64).reshape(-1, 3)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(found) for found, _ in made]]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=parts))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([c for _, c in made], pa.binary()).cast(pa.string())], names=[*batch.schema.names, *names])
                start, total = i + 1, 0

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField(names[0], RUN), T.StructField(names[1], T.StringType())]))


def with_tails(text: Column, id: Column) -> Column:
    """The text, or, for ids whose CRC-32 ends in 0, its words with a tail that repeats: from word a on, the p words there over and over. A null id counts as an empty one."""
    h = F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary"))
    g, words = F.floor(h / 10), words_of(text)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, (F.ceil((n - a) / p) + 1).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of runs, its longest run, digests of all runs and of the collapsed text."""
    docs = documents(spark, sf_dir).select("doc_id", with_tails(text_of("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    milli = F.floor(1000 * length / period)
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
