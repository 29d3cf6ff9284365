"""Importance resampling, BPE by recursive queries and periodic runs against brute force, the tiktoken library and plain scans."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from tests.llm.test_ops import BASE, SCHEMA, rows, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table():
    """The hard cases, and texts of letters, marks, white space and repeats with many ids."""
    rng, out = random.Random(11), rows()
    for i in range(100, 400):
        words = [rng.choice(["aa", "b", "Éa", "日本", "x'll", "...", "12"]) for _ in range(rng.randint(0, 40))]
        words = (words * rng.choice([1, 1, 2, 5]))[: rng.randint(0, 120)]
        out.append((i, rng.choice([" ", "\n", "  "]).join(words), "en", "s", 1, "x", "y", 1))
    return out


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    return write(spark.createDataFrame(table(), SCHEMA).repartition(5), tmp_path_factory.mktemp("many"))


def got(df):
    return Counter(map(tuple, df.collect()))


def resampled(docs, target, seed=2024, buckets=10_000):
    """Brute force of the formulas, in the order of the ranks."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    bag = lambda t: Counter(zlib.crc32(w.encode()) % buckets for w in FEATURE.findall(low(t)))
    bags, s, t = [bag(d[1]) for d in docs], Counter(), Counter()
    for b in bags:
        s += b
    for x in target:
        t += bag(x)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for (i, *_), b in zip(docs, bags, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(k) for k, n in b.items())
        out.append((i, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    out.sort(key=lambda r: (r[1] < 20, -r[3], r[0] is None, r[0] or 0))
    draw = 10 * sum(r[1] >= 20 for r in out) // 100
    return [(*r, k if k <= draw else None) for k, r in enumerate(out, 1)]


def test_op11_against_brute_force(spark, at):
    from docspark.llm.queries import QUERIES

    assert got(QUERIES["op11_importance_resampling"](spark, at)) == Counter(resampled(table(), [BASE, None, "two k1 K2 two"]))


def test_op11_without_target_and_with_runs_of_three(spark):
    from docspark.llm.op11_importance_resampling import importance_resample

    docs = spark.createDataFrame([(1, "a b c a b"), (2, None), (2, "a")], "doc_id long, text string")
    out = {(r.doc_id, r.n_words): (r.n_features, r["rank"]) for r in importance_resample(docs, docs.limit(0), n=3, percent=50, least=1).collect()}
    assert {k: v[0] for k, v in out.items()} == {(1, 5): 12, (2, 0): 0, (2, 1): 1}
    assert sorted((v[1] for v in out.values()), key=str) == [1, None, None]


def test_ring_in_pieces():
    from docspark.llm.op11_importance_resampling import FOLD, run_buckets

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB1 -é\n") for _ in range(rng.randint(0, 60))).encode()
        words = text.translate(FOLD).split()
        for n in (1, 2, 3):
            want = sorted(zlib.crc32(b" ".join(words[i:j])) % 97 for j in range(1, len(words) + 1) for i in range(max(0, j - n), j))
            for piece in (1, 3, 1000):
                count, found = run_buckets(text, n, 97, piece)
                assert (count, sorted(found.tolist())) == (len(words), want)


def tiktoken_of(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op12_against_the_library(spark, at):
    import base64

    from docspark.llm.op12_duckdb_bpe import default_ranks
    from docspark.llm.queries import QUERIES

    with open(default_ranks(), "rb") as f:
        library = tiktoken_of({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})
    want = Counter()
    for i, text, *_ in table():
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got(QUERIES["op12_duckdb_bpe"](spark, at)) == want


def test_op12_long_matches_columns_and_nulls(spark):
    from docspark.llm.op12_duckdb_bpe import Database, decode, default_pattern, default_ranks, encode, ranks_of

    with open(default_ranks(), "rb") as f:
        ranks = ranks_of(f.read(), default_pattern())
    assert ranks.proper
    library, database, rng = tiktoken_of({t: i for i, t in ranks.tokens.items()}), Database(ranks), random.Random(2)
    texts = ["a" * 5000, " " * 3000 + "x", "=-" * 700, "".join(rng.choices("abcdefghij", k=2000)), "日本語テキスト" * 99, "".join(rng.choices("ab", k=40_000)), "<|endoftext|> it's\x00"]
    assert [x.tolist() for x in database.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([("it's a  test", 1), (None, None), ("", 2)], "text string, ids int")
    out = encode(df, default_ranks())
    assert out.columns == ["text", "ids", "ids_"]
    back = decode(out.withColumnRenamed("ids_", "coded").selectExpr("text", "if(text = '', null, coded) AS coded"), default_ranks(), ids="coded")
    assert sorted((r.text or "", bytes(r.decoded)) for r in back.collect()) == [("", b""), ("", b""), ("it's a  test", b"it's a  test")]


def test_op12_ranks_that_are_not_proper():
    import base64

    from docspark.llm.op12_duckdb_bpe import Database, default_pattern, ranks_of

    rng = random.Random(5)
    for _ in range(5):
        tokens = {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(25)}
        ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *sorted(tokens, key=lambda t: rng.random())])}
        ours = ranks_of(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()), default_pattern())
        assert not ours.proper
        texts = ["".join(rng.choices("abc ", k=rng.randint(0, 200))) for _ in range(50)]
        library = tiktoken_of(ranks)
        assert [x.tolist() for x in Database(ours).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def runs_by_scan(x, least=12):
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_op13_runs_against_a_scan():
    from docspark.llm.op13_periodic_runs import runs, text_runs

    rng = random.Random(7)
    for _ in range(1500):
        m, n, x = rng.choice([1, 2, 2, 3, 8]), rng.randint(0, 80), []
        while len(x) < n:
            if x and rng.random() < 0.5:
                a = rng.randrange(len(x))
                for i in range(rng.randint(1, 30)):
                    x.append(x[a + i])
            else:
                x.append(rng.randrange(m))
        assert runs(x, 2) == runs_by_scan(x, 2)
        assert text_runs(" ".join(map(str, x)).encode())[0] == runs_by_scan(x)


def test_op13_against_brute_force(spark, at):
    from docspark.llm.queries import QUERIES

    want, planted = Counter(), 0
    for i, text, *_ in table():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = runs_by_scan(words) if n < 1000 else []
        planted += bool(h % 10 == 0 and found)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert planted > 3
    assert got(QUERIES["op13_periodic_runs"](spark, at)) == want


def test_op13_columns_and_empty_texts(spark):
    from docspark.llm.op13_periodic_runs import periodic_runs

    df = spark.createDataFrame([("a b " * 6 + "c", 1), (None, None), (" \n", 2), ("x", 3)], "text string, runs int")
    out = periodic_runs(df)
    assert out.columns == ["text", "runs", "runs_", "collapsed"]
    assert sorted((r.collapsed, [tuple(x) for x in r.runs_]) for r in out.collect()) == [("", []), ("", []), ("a b c", [(0, 12, 2)]), ("x", [])]
    assert periodic_runs(df.limit(0)).count() == 0
