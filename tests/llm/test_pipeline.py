"""Every stage of the corpus pipeline on a small hard table against a brute-force version, on an empty table, and run() over all of them."""

import re
from collections import Counter

import pytest
from tests.llm.test_ops import WORD, kept_lines, low

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, ids int, kept int"


def table():
    base = " ".join(f"word{i}" for i in range(40))
    near = base.replace("word20 ", "other ")
    texts = [base, base, near, None, "", "  \n", "short text", f"{base}\n{base}", f"one two three {base}\nsome line of its own here", "a b c d e " * 9, " ".join(f"q{i % 7}x{i}" for i in range(3000)), "tiny\n" + " ".join(f"z{i}" for i in range(30))]
    out = [(i, t, ["en", None][i % 2], ["s1", "s1", "s1", None, "s2"][i % 5], None if t is None else len(t), "r", 1, 2) for i, t in enumerate(texts)]
    return [*out, out[10], (None, base + " null id", "en", "s2", 9, "r", 1, 2), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def good(rows):
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            out.append(r)
    return Counter(out)


def test_keep_good(docs, known):
    from docspark.llm.stages import keep_good

    assert rows_of(keep_good(docs, known)) == good(table())  # with so few labels no cutoff can be proven


def test_drop_lines(docs):
    from docspark.llm.stages import drop_lines

    left = {(i, t): n for (i, t, gone), n in kept_lines(table()).items() if not gone or WORD.search(t)}
    got = drop_lines(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(left)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.doc_id == 8)


def test_drop_near_duplicates(docs):
    from docspark.llm.stages import drop_near_duplicates

    def shingles(t):
        w = WORD.findall(low(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    data = sorted(table(), key=lambda r: (r[0] is None, r[0] or 0))
    group = list(range(len(data)))
    for _ in data:  # labels spread along links until they stand
        for a in range(len(data)):
            for b in range(a):
                x, y = shingles(data[a][1]), shingles(data[b][1])
                if x and y and len(x & y) * 100 >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    assert rows_of(drop_near_duplicates(docs)) == Counter(r for i, r in enumerate(data) if group[i] == i)


def test_mix_sources(docs):
    from docspark.llm.op3_mixing import mix
    from docspark.llm.stages import mix_sources

    got, sizes, target = rows_of(mix_sources(docs)), {}, {r.source: r.target for r in mix(docs)[0].select("source", "target").distinct().collect()}
    for r, n in got.items():
        assert n <= 2 * table().count(r) and WORD.search(r[1])
        sizes.setdefault(r[3], []).extend([len(WORD.findall(r[1]))] * n)
    # whole documents: each source comes as near to its target as its largest document allows
    most = Counter()
    for r in table():
        most[r[3]] = max(most[r[3]], len(WORD.findall(r[1] or "")))
    assert all(abs(sum(sizes.get(s, [0])) - t) <= most[s] for s, t in target.items())


def test_tokens(docs):
    from tokenizers import Tokenizer

    from docspark.llm.op10_bpe import default_tokenizer
    from docspark.llm.stages import tokens

    t = Tokenizer.from_file(default_tokenizer())
    out = tokens(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_row", "ids", "kept", "ids_", "n_tokens", "ids_sha256", "decoded_sha256"]
    expect = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in table())
    assert Counter((r.doc_id, tuple(r.ids_)) for r in out.collect()) == expect
    assert tokens(docs.select("text")).count() == len(table())


def test_run(spark, docs, known, tmp_path):
    import corpus_pipeline

    for name, some in (("full", table()), ("empty", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{at}/documents.parquet")
        known.write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.count() == 0 if not some else {r.doc_id for r in out.select("doc_id").collect()} >= {10, 11}
    assert [re.fullmatch(r"[a-z_]+", n) is not None for n, _ in corpus_pipeline.STAGES] == [True] * 5
