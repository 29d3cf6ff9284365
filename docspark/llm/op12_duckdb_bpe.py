r"""Byte-level BPE by recursive queries: each Spark task has a DuckDB database in memory that merges and decodes its rows.

The splitting pattern cuts a text into matches; a match that is a token itself is one, as in tiktoken. The bytes of the others
become rows (word, position, id). A recursive query joins neighbours with the table of merges and contracts each word's
leftmost pair of least rank, until no row of a word finds a merge. The table of merges has a row for each token: the two parts
that its own bytes are in when only lower ranks have been merged. A rank file whose tokens all have two such parts is proper;
one that isn't has a row for every way to cut a token in two.

Matches longer than SHORT bytes would need as many rounds as merges. In a proper file merges make only pairs of higher rank.
A pair that has the least rank within `reach` pairs on both sides, the bytes of the longest token, is therefore contracted sooner
or later whatever happens elsewhere, for that would have to grow into one token that covers all between. A round on long
matches contracts all such pairs (of overlapping equals, as in aaaa, every other one from the left). Matches longer than BLOCK
bytes are merged in blocks, each with the lookahead that settles its tokens (see op10).

Results of short matches are kept in a memo of bounded size: a slot for each, whose ids stand in one array; a text's ids are gathered from it. A query has at most ROWS octets, or one block. Decoding joins ids
with the table of tokens and aggregates their bytes in order of position, at most IDS ids a query. No query spills, for DuckDB
has no folder of its own: memory is that of a batch. No shuffle; the rank file's two tables are broadcast, their size is the
vocabulary's. In a file that isn't proper a long match is merged whole, with all its rounds in memory.

Cases: a null text encodes as an empty one, without ids, and decodes to no bytes. Null ids decode to no bytes; ids that the
vocabulary lacks are an error. Repeated rows and ids, nulls in other columns and further columns pass through; an added column
whose name exists gets underscores behind its own, and stands last. Texts longer than a batch are batches of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import documents, fresh, text_of
from docspark.llm.op10_bpe import LATIN, NOT_LATIN, sufficient_lookahead

SHORT, BLOCK, ROWS, IDS, BATCH = 64, 1 << 15, 1 << 16, 1 << 18, 1 << 20
#: Short matches in the memo.
CACHE = 250_000


class Ranks(NamedTuple):
    """A rank file as two tables: tokens (bytes by id) and merges (left, right, made)."""

    tokens: dict[int, bytes]
    merges: np.ndarray
    proper: bool
    pattern: str


def parts_below(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that a token's bytes are in when all merges below a rank are done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        low, i = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if low >= rank:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def ranks_of(content: bytes, pattern: str) -> Ranks:
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    long = {t: r for t, r in ranks.items() if len(t) > 1}
    split = [(parts_below(t, r, ranks), r) for t, r in long.items()]
    proper = all(len(p) == 2 for p, _ in split)
    if proper:
        rows = [(ranks[a], ranks[b], r) for (a, b), r in split]
    else:
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in long.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return Ranks({r: t for t, r in ranks.items()}, np.array(rows, np.int32).reshape(-1, 3), proper, pattern)


#: A row has the id at its place and the next one; a round finds a word's leftmost pair of least rank (k: rank, place), joins the row behind it, and passes on what the contraction leaves. A word that finds no pair passes on nothing: its last step stands.
ENCODE = """
WITH RECURSIVE state(step, word, n, id, after, made) AS (
  SELECT 0, word, n, id, after, made FROM octets LEFT JOIN merges ON a = id AND b = after
  UNION ALL
  (WITH best AS (
     SELECT word, min((made::BIGINT << 32) | n) AS k FROM state WHERE made IS NOT NULL GROUP BY word
   ), site AS (
     SELECT best.word, (k >> 32)::INTEGER AS pair, (k & 4294967295)::INTEGER AS p, behind.after FROM best JOIN state AS behind ON behind.word = best.word AND behind.n = (k & 4294967295)::INTEGER + 1
   ), moved AS (
     SELECT step + 1 AS step, word, CASE WHEN n > p THEN n - 1 ELSE n END AS n, CASE WHEN n = p THEN pair ELSE id END AS id,
       CASE WHEN n = p THEN site.after WHEN n = p - 1 THEN pair ELSE s.after END AS after
     FROM state AS s JOIN site USING (word) WHERE n <> p + 1
   )
   SELECT step, word, n, id, after, made FROM moved LEFT JOIN merges ON a = id AND b = after)
), done AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT word, list(id ORDER BY n) AS ids FROM state JOIN done USING (word, step) GROUP BY word ORDER BY word
"""
#: The same for long words of proper files, many pairs a round: `lowest` has the least rank within reach; from the start of a row of equal pairs, as far as all of it is lowest, every other pair joins. recurring.state has all rows by key, state those that changed; a row that is gone keeps its key with id -1.
ENCODE_LONG = """
WITH RECURSIVE state(word, n, id) USING KEY (word, n) AS (
  SELECT word, n, id FROM octets
  UNION
  (WITH pairs AS (
     SELECT word, n, id, row_number() OVER o AS i, lead(id) OVER o AS after FROM recurring.state WHERE id >= 0 AND word IN (SELECT word FROM state) WINDOW o AS (PARTITION BY word ORDER BY n)
   ), ranked AS (
     SELECT pairs.*, made FROM pairs LEFT JOIN merges ON a = id AND b = after
   ), least AS (
     SELECT *, coalesce(made = min(made) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING), false) AS lowest, i - row_number() OVER (PARTITION BY word, made ORDER BY i) AS run FROM ranked
   ), chosen AS (
     SELECT *, lowest AND bool_and(lowest) OVER r AND row_number() OVER r % 2 = 1 AS joins FROM least WINDOW r AS (PARTITION BY word, made, run ORDER BY i)
   ), moved AS (
     SELECT *, lag(joins, 1, false) OVER (PARTITION BY word ORDER BY i) AS gone FROM chosen
   )
   SELECT word, n, CASE WHEN gone THEN -1 ELSE made END FROM moved WHERE gone OR joins)
)
SELECT word, list(id ORDER BY n) AS ids FROM state WHERE id >= 0 GROUP BY word ORDER BY word
"""
DECODE = "SELECT part, unhex(string_agg(hex, '' ORDER BY pos)) AS data FROM coded JOIN tokens USING (id) GROUP BY part ORDER BY part"


class Database:
    """The database of one Python worker."""

    def __init__(self, ranks: Ranks):
        import duckdb

        self.ranks, self.pieces, self.latin = ranks, regex.compile(ranks.pattern), ranks.pattern == default_pattern()
        self.whole = {t: i for i, t in ranks.tokens.items()}
        self.is_id = np.isin(np.arange(max(ranks.tokens) + 1), list(ranks.tokens))
        self.of_byte = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        self._forget()
        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        a, b, made = ranks.merges.T
        self._table("merges", a=a, b=b, made=made)
        self._table("tokens", id=np.array(list(ranks.tokens), np.int32), hex=pa.array([t.hex() for t in ranks.tokens.values()]))
        self.long_sql = ENCODE_LONG.format(reach=max(map(len, ranks.tokens.values())))
        by_rank = sorted(map(tuple, ranks.merges.tolist()), key=lambda m: m[2])
        self.lookahead = sufficient_lookahead([(ranks.tokens[a], ranks.tokens[b]) for a, b, _ in by_rank]) if ranks.proper else 0

    def _table(self, name: str, **columns) -> None:
        rows = pa.table(columns)  # noqa: F841  the query finds it by its name
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")

    def _forget(self) -> None:
        """An empty memo: memo has each match's slot, whose ids are pool[begin[slot] : begin[slot + 1]]."""
        self.memo: dict[str, int] = {}
        self.pool, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.memo.update(zip(words, range(len(self.begin) - 1, len(self.begin) - 1 + len(words)), strict=True))
        self.pool = np.concatenate([self.pool, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, all of them short or all long, and the ids, by one recursive query."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.append(ids[1:], -1)
        after[ends - 1] = -1
        of, n = np.repeat(np.arange(len(words), dtype=np.int32), sizes), np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        octets = pa.table({"word": of, "n": n.astype(np.int32), "id": ids, "after": after})  # noqa: F841  the query finds it by its name
        lists = self.con.sql(self.long_sql if self.ranks.proper and len(words[0]) > SHORT else ENCODE).to_arrow_table()["ids"].combine_chunks()
        return pa.compute.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length, block by block."""
        out: list[np.ndarray] = []
        while len(word) > BLOCK + self.lookahead:
            ids = self._merged([word[: BLOCK + self.lookahead]])[1]
            ends = np.cumsum([len(self.ranks.tokens[i]) for i in ids.tolist()])
            settled = int(np.searchsorted(ends, BLOCK, "right"))
            out.append(ids[:settled])
            word = word[ends[settled - 1] :]
        return np.concatenate([*out, self._merged([word])[1]])

    def words_of(self, text: str) -> list[str]:
        return (LATIN if self.latin and not NOT_LATIN.search(text) else self.pieces).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > CACHE:
            self._forget()
        split = [self.words_of(t) for t in texts]
        words = list(chain.from_iterable(split))
        slots = self._slots(words)
        new = np.flatnonzero(slots < 0)
        long = self._learn({words[i] for i in new.tolist()})
        slots[new] = self._slots([words[i] for i in new.tolist()])
        sizes = np.diff(self.begin)[slots]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.begin[slots] - (ends - sizes), sizes) + np.arange(len(slots) and ends[-1])]
        if long:  # long matches aren't kept; they have the last slots
            for w in long:
                del self.memo[w]
            self.begin = self.begin[: len(self.memo) + 1]
            self.pool = self.pool[: self.begin[-1]]
        at = np.append(0, ends)[np.cumsum([0, *map(len, split)])]
        return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _slots(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))

    def _learn(self, new: set[str]) -> list[str]:
        """Put matches into the memo, the long ones that are no tokens last; these are returned."""
        coded = [(w, w.encode()) for w in new]
        known = [(w, i) for w, data in coded if (i := self.whole.get(data)) is not None]
        self._keep([w for w, _ in known], np.ones(len(known), np.int64), np.array([i for _, i in known], np.int32))
        rest = sorted((x for x in coded if x[0] not in self.memo), key=lambda x: len(x[1]))  # words of a query need like numbers of rounds
        long = [x for x in rest if len(x[1]) > SHORT]
        self._drain(rest[: len(rest) - len(long)])
        if self.ranks.proper:
            for w, data in long:
                ids = self._long(data)
                self._keep([w], np.array([len(ids)]), ids)
        else:
            self._drain(long)
        return [w for w, _ in long]

    def _drain(self, queue: list[tuple[str, bytes]]) -> None:
        start = size = 0
        for i, (_, data) in enumerate(queue, 1):
            size += len(data)
            if size >= ROWS or i == len(queue):
                self._keep([w for w, _ in queue[start:i]], *self._merged([d for _, d in queue[start:i]]))
                start, size = i, 0

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        out = [[] for _ in lists]
        sizes = np.array([len(x) for x in lists], np.int64)
        ids, of = np.concatenate([np.zeros(0, np.int32), *lists]), np.repeat(np.arange(len(lists)), sizes)
        for at in range(0, len(ids), IDS):
            step = slice(at, at + IDS)
            coded = pa.table({"part": of[step], "pos": np.arange(len(ids[step]), dtype=np.int32), "id": ids[step]})
            if ids[step].min() < 0 or ids[step].max() >= len(self.is_id) or not self.is_id[ids[step]].all():
                raise ValueError("an id is not in the vocabulary")
            for part, data in zip(*self.con.sql(DECODE).to_arrow_table().to_pydict().values(), strict=True):
                out[part].append(data)
            del coded
        return [b"".join(x) for x in out]


_OPEN: dict[int, Database] = {}


def _database(ranks: Ranks) -> Database:
    """This worker's database, built once a vocabulary."""
    key = hash((ranks.pattern, len(ranks.tokens), ranks.merges.tobytes()))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Database(ranks)
    return _OPEN[key]


def _mapped(df: DataFrame, ranks_path: str, pattern: str, column: str, added: list[tuple[str, T.DataType]], make) -> DataFrame:
    """df with columns made of one column's values, batch by batch."""
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(ranks_of(f.read(), pattern))
    at, names = df.columns.index(column), fresh(df, *[n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            database, values, start, size = _database(ranks.value), batch.column(at), 0, 0
            measure = pa.compute.list_value_length if pa.types.is_list(values.type) else pa.compute.binary_length
            sizes = pa.compute.fill_null(measure(values), 0).to_pylist()
            for i, n in enumerate(sizes):
                size += n
                if size >= BATCH or i == len(sizes) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, *make(database, part.column(at))], names=[*batch.schema.names, *names])
                    start, size = i + 1, 0

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, (_, t) in zip(names, added, strict=True)]]))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(df: DataFrame, ranks_path: str, pattern: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with array<int> column `ids` at its end: the tokens of each whole text."""
    return _mapped(df, ranks_path, pattern or default_pattern(), text, [(ids, T.ArrayType(T.IntegerType()))], lambda d, texts: [_lists(d.encode([t or "" for t in texts.to_pylist()]))])


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df with binary column `data` at its end: the bytes of the ids."""
    return _mapped(df, ranks_path, default_pattern(), ids, [(data, T.BinaryType())], lambda d, lists: [pa.array(d.decode([np.array(x or [], np.int32) for x in lists.to_pylist()]), pa.binary())])


def round_trip(df: DataFrame, ranks_path: str, pattern: str | None = None, text: str = "text", packed: str = "packed", decoded: str = "decoded") -> DataFrame:
    """df with two binary columns at its end, made in one pass: the ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""

    def make(d: Database, texts: pa.Array) -> list[pa.Array]:
        ids = d.encode([t or "" for t in texts.to_pylist()])
        return [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(d.decode(ids), pa.binary())]

    return _mapped(df, ranks_path, pattern or default_pattern(), text, [(packed, T.BinaryType()), (decoded, T.BinaryType())], make)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op12_duckdb_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Per document: number of tokens, digest of the packed ids and digest of the bytes that they decode to."""
    docs = documents(spark, sf_dir).select("doc_id", text_of("text").alias("text"))
    coded = round_trip(docs, ranks_path or default_ranks())
    n = (F.octet_length("packed") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
