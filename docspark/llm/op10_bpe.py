"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Let a text w be followed by anything at all. Merges run in order of rank, so the encodings of w and of the longer text
differ only to the right of a front that starts at the end of w. The front moves left by len(a) when a merge (a, b) happens
in one of the two only; one side then has the token ab at the front, the other a. The next such merge has a higher rank and
its right part is the token at the front of either side, which meanwhile may have grown to the right by merges of rising
rank. `sufficient_lookahead` adds up the longest chain of such moves over the merge list in one pass. Tokens that end that
many bytes before the end of what has been read are stable: they are emitted, and only the rest is kept.

Every text is fed to a transducer in pieces of at most PIECE characters. The splitting pattern needs three characters of
lookahead: what it matches before them is a finished run of characters, whose bytes go through a run's own machine (or its
memo, for runs seen before); a run that has no end yet is fed on while it is read. Memory is bounded by the piece, the
lookahead and a memo of bounded size, whatever the length of the text. Decoding maps ids to bytes and runs them through an
incremental UTF-8 state machine, piece by piece.

Cases: a null text encodes as an empty one (no ids; it decodes to an empty text). Null ids decode to an empty text. Repeated
rows and ids, nulls in other columns and further columns pass through as they are; an added column whose name exists gets
underscores behind its own, and stands last.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import documents, fresh, text_of

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a match of PATTERN that decide whether it stands: 'll takes three.
PATTERN_LOOKAHEAD = 3
#: The same pattern for texts below U+0250, for the quicker engine of the standard library.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
LATIN = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NOT_LATIN = re.compile("[^\x00-\u024f]")
PIECE, HELD = 1 << 16, 4096
BLOCK = 4096
CACHE = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes follow from U+0100 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file says, as bytes: merges with ranks, ids, and added tokens that are cut out of a text first."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], added: dict[str, int]):
        self.ids, self.added = ids, added
        #: The rank of the merge of two ids, and the id that the merge of a rank makes.
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [ids[a + b] for a, b in merges]
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault((ids[a], ids[b]), rank)
        self.of_byte = [ids.get(bytes([b]), -1) for b in range(256)]
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        self.longest = max(map(len, ids), default=1)
        self.lookahead = sufficient_lookahead(merges)

    @classmethod
    def from_json(cls, content: str) -> Vocabulary:
        """From the content of a tokenizers file of kind byte-level BPE."""
        j = json.loads(content)
        if j["model"]["type"] != "BPE" or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or j.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        alphabet = byte_alphabet()
        as_bytes = lambda t: bytes(alphabet[c] for c in t)
        merges = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in j["model"]["merges"]]
        added = {t["content"]: t["id"] for t in j["added_tokens"]}
        ids = {as_bytes(t): i for t, i in j["model"]["vocab"].items() if t not in added}
        return cls(merges, ids, added)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that settle it, whatever follows. One pass over the merges from the last to the first: reach[t] is how far the front can still move left when one side has the token t there and only merges of higher rank are left."""
    reach: dict[bytes, int] = {}
    most = 0
    for a, b in reversed(merges):
        grown = reach.get(a + b, 0)
        moved = len(a) + max(reach.get(a, 0), grown)
        most = max(most, moved)
        reach[b] = max(reach.get(b, 0), moved)
        reach[a] = max(reach.get(a, 0), grown)
    return most


def merge(data: bytes, v: Vocabulary) -> list[int]:
    """The ids of bytes that no pattern splits: the merge of lowest rank first, the leftmost of equals."""
    ids = [v.of_byte[b] for b in data]
    if -1 in ids:
        raise ValueError("a byte is not in the vocabulary")
    get, made, n = v.rank.get, v.made, len(ids)
    none = len(made)
    if n <= 64:
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), none)
        return ids
    after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p)) is not None]  # noqa: B905
    heapq.heapify(heap)
    while heap:
        rank, i, (a, b) = heapq.heappop(heap)
        j = after[i]
        if not live[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        new = ids[i] = made[rank]
        live[j], after[i] = False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := get(p := (new, ids[after[j]]))) is not None:
                heapq.heappush(heap, (r, i, p))
        if before[i] >= 0 and (r := get(p := (ids[before[i]], new))) is not None:
            heapq.heappush(heap, (r, before[i], p))
    return [t for t, ok in zip(ids, live, strict=True) if ok]


class Run:
    """Encodes one unsplit run of bytes that arrives in parts, with memory for the lookahead and one block."""

    def __init__(self, v: Vocabulary):
        self.v, self.held = v, b""

    def feed(self, data: bytes) -> Iterator[int]:
        at = 0
        while at < len(data):
            step = data[at : at + BLOCK]
            at += len(step)
            self.held += step
            if len(self.held) < self.v.lookahead + max(BLOCK, self.v.longest):
                continue
            stable, end = len(self.held) - self.v.lookahead, 0
            for t in merge(self.held, self.v):
                if end + len(self.v.bytes_of[t]) > stable:
                    break
                end += len(self.v.bytes_of[t])
                yield t
            self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        yield from merge(self.held, self.v) if self.held else ()
        self.held = b""


class Encoder:
    """What the transducers of one vocabulary share: the pattern and the memo of runs."""

    def __init__(self, v: Vocabulary):
        self.v, self.pieces = v, regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(v.added, key=len, reverse=True)) + ")") if v.added else None

    def encode(self, text: str, piece: int = PIECE, held: int = HELD) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.v.added:
                out.append(self.v.added[part])
                continue
            machine = Transducer(self, held)
            for at in range(0, len(part), piece):
                out += machine.feed(part[at : at + piece])
            out += machine.finish()
        return out

    def runs(self, words: list[str]) -> Iterable[int]:
        """The ids of finished runs."""
        found = list(map(self.memo.get, words))
        if None in found:
            found = [self._new(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return chain.from_iterable(found)

    def _new(self, word: str) -> tuple[int, ...]:
        if (ids := self.memo.get(word)) is None:
            run = Run(self.v)
            ids = (*run.feed(_utf8(word)), *run.finish())
            if len(word) < 64:
                if len(self.memo) >= CACHE:
                    self.memo.clear()
                self.memo[word] = ids
        return ids


class Transducer:
    """Encodes a text that arrives in pieces. What is held between them: the characters that the pattern may still join with what follows, at most `held` and the lookahead; a longer run is open, its bytes are with its own machine."""

    CLASSES = tuple(map(regex.compile, (r"\p{L}*+", r"\p{N}*+", r"[^\s\p{L}\p{N}]*+", r"\s*+")))

    def __init__(self, encoder: Encoder, held: int = HELD):
        self.encoder, self.most = encoder, held
        self.held, self.of, self.run = "", None, None

    def _words(self, buf: str) -> list[str]:
        return (self.encoder.pieces if NOT_LATIN.search(buf) else LATIN).findall(buf)

    def _close(self, buf: str, end: int, out: list[int]) -> str:
        """Ends the open run at a place of buf."""
        if end < len(buf) and self.of is self.CLASSES[-1]:
            end -= 1  # the last white space before a word goes with the word
        out += self.run.feed(_utf8(buf[:end]))
        out += self.run.finish()
        self.of = self.run = None
        return buf[end:]

    def feed(self, piece: str) -> list[int]:
        out: list[int] = []
        buf = self.held + piece
        if self.run:
            end = self.of.match(buf).end()
            if end > len(buf) - PATTERN_LOOKAHEAD:
                out += self.run.feed(_utf8(buf[:-PATTERN_LOOKAHEAD]))
                self.held = buf[-PATTERN_LOOKAHEAD:]
                return out
            buf = self._close(buf, end, out)
        words, n = self._words(buf), 0
        while words and n < PATTERN_LOOKAHEAD:
            n += len(words.pop())
        out += self.encoder.runs(words)
        self.held = buf[len(buf) - n :]
        if n > self.most + PATTERN_LOOKAHEAD:
            first = self.encoder.pieces.match(self.held)[0]
            if len(first) < n:
                out += self.encoder.runs([first])
                self.held = self.held[len(first) :]
            else:
                self.of, self.run = next(r for r in self.CLASSES if r.match(first[1]).end()), Run(self.encoder.v)
                out += self.run.feed(_utf8(self.held[:-PATTERN_LOOKAHEAD]))
                self.held = self.held[-PATTERN_LOOKAHEAD:]
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        buf = self._close(self.held, self.of.match(self.held).end(), out) if self.run else self.held
        out += self.encoder.runs(self._words(buf))
        self.held = ""
        return out


def _utf8(s: str) -> bytes:
    return s.encode("utf-8", "replace")


class Decoder:
    """Ids to text, by parts; bytes of an unfinished character wait for the next part."""

    def __init__(self, v: Vocabulary):
        self.bytes_of = [v.bytes_of.get(i, b"") for i in range(max(v.bytes_of, default=-1) + 1)]

    def decode(self, ids: Iterable[int], step: int = PIECE) -> str:
        """Ids that the vocabulary has not decode to nothing; bytes that are no UTF-8 to U+FFFD."""
        state, of, out = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of, []
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            try:
                data = b"".join([of[i] for i in part])
            except IndexError:
                data = b"".join([of[i] for i in part if i < len(of)])
            out.append(state.decode(data))
        out.append(state.decode(b"", final=True))
        return "".join(out)


_LOADED: dict[int, tuple[Vocabulary, Encoder, Decoder]] = {}


def _loaded(content: str) -> tuple[Vocabulary, Encoder, Decoder]:
    """The vocabulary of this Python worker, built once."""
    if (key := hash(content)) not in _LOADED:
        _LOADED.clear()
        v = Vocabulary.from_json(content)
        _LOADED[key] = v, Encoder(v), Decoder(v)
    return _LOADED[key]


#: Characters of text, and ids, in a batch that goes back to the JVM.
BATCH = 1 << 20


def _sliced(rows: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _mapped(df: DataFrame, path: str, column: str, added: list[tuple[str, T.DataType]], make) -> DataFrame:
    """df with columns made of one column's values, batch by batch. The tokenizer's file is read by the driver and sent as a broadcast; it is a vocabulary, so its size does not follow the data."""
    with open(path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    at, names = df.columns.index(column), fresh(df, *[n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(content.value)
        for batch in batches:
            values = batch.column(at)
            size = pa.compute.list_value_length if pa.types.is_list(values.type) else pa.compute.binary_length
            for a, b in _sliced(batch, pa.compute.fill_null(size(values), 0).to_pylist(), BATCH):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *make(loaded, values.slice(a, b - a).to_pylist())], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, (_, t) in zip(names, added, strict=True)]]))


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = [0]
    for x in ids:
        ends.append(ends[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(ids)), pa.int32()))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with array<int> column `ids` at its end: the tokens of each whole text, null read as empty."""
    return _mapped(df, tokenizer_path, text, [(ids, T.ArrayType(T.IntegerType()))], lambda m, texts: [_lists([m[1].encode(t or "") for t in texts])])


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with string column `text` at its end: what the ids stand for; special tokens are kept, null ids give an empty text."""
    return _mapped(df, tokenizer_path, ids, [(text, T.StringType())], lambda m, lists: [pa.array([m[2].decode(x or []) for x in lists], pa.string())])


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with both columns at its end, made in one pass through Python."""

    def make(m, texts):
        coded = [m[1].encode(t or "") for t in texts]
        return [_lists(coded), pa.array([m[2].decode(x) for x in coded], pa.string())]

    return _mapped(df, tokenizer_path, text, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], make)


def digests(ids: str, decoded: str) -> tuple[Column, Column, Column]:
    """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text; lowercase hex."""
    listed = F.concat_ws(",", F.col(ids).cast("array<string>")).cast("binary")
    return F.size(ids).cast("long"), F.sha2(listed, 256), F.sha2(F.col(decoded).cast("binary"), 256)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of the text that they decode to."""
    docs = documents(spark, sf_dir).select("doc_id", text_of("text").alias("text"))
    coded = round_trip(docs, tokenizer_path or default_tokenizer())
    n, ids, decoded = digests("ids", "decoded")
    return coded.select("doc_id", n.alias("n_tokens"), ids.alias("ids_sha256"), decoded.alias("decoded_sha256"))
