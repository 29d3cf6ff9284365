"""Operators against brute force where keys clash, languages are many, and base phrases overlap."""

import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_ops import SCHEMA, write


def test_op5_keys_that_clash(spark, monkeypatch):
    from docspark.llm import op5_ngram_join as op5

    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=80)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(t + f" end{j}" for t in base for j in range(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(tuple(r) for r in op5.ngram_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert len({r[2] for r in want}) == 6
    asked = op5._search
    seen = []

    def clashing(pairs, classes, docs, k, percent):
        seen.append(1)
        monkeypatch.setattr(op5, "key_of", lambda text: F.lit(7).cast("long"))  # every text has the same key when texts are read again
        out = asked(pairs, classes.withColumn("key", F.lit(7).cast("long")), docs, k, percent)
        monkeypatch.undo()
        return out

    monkeypatch.setattr(op5, "_search", clashing)
    got = sorted(tuple(r) for r in op5.ngram_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want and seen


def test_op6_more_languages_than_it_learns(spark, tmp_path, monkeypatch):
    from docspark.llm import op6_language_crf as op6

    monkeypatch.setattr(op6, "MAX_LANGUAGES", 2)
    rows = [(i, " ".join([["the", "und", "avec"][i % 3] * 2] * 5), ["en", "de", "fr"][i % 3], "s", 1, "x", "y", 1) for i in range(60)]
    rows += [(100 + i, "the", "en", "s", 1, "x", "y", 1) for i in range(9)] + [(200 + i, "und", "de", "s", 1, "x", "y", 1) for i in range(6)]
    rows.append((300, "zzz " * 50_000, "fr", "s", 1, "x", "y", 1))
    out = op6.op6_language_crf(spark, write(spark.createDataFrame(rows, SCHEMA), tmp_path)).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out} <= {"en", "de"}


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def test_op9_base_columns_by_scan(spark, tmp_path):
    from docspark.llm.op9_license_scan import op9_license_scan

    rng, rows = random.Random(8), []
    pool = ["MIT", "License", "license", "apache", "Apache", "general", "public", "GNU", "x", "é", "v2", "mit-license", "the"]
    for i in range(300):
        rows.append((i, "".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "--"]) for _ in range(rng.randint(0, 25))), "en", "s", 1, "x", "y", 1))
    rows += [(300, None, "en", "s", 1, "x", "y", 1), (301, "", "en", "s", 1, "x", "y", 1)]
    out = op9_license_scan(spark, write(spark.createDataFrame(rows, SCHEMA).repartition(3), tmp_path)).collect()
    want = {}
    for i, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want[i] = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out} == want
    for r in out:
        own, every = set(filter(None, r.base_labels.split(","))), set(filter(None, r.labels.split(",")))
        assert own <= every and 0 <= r.score <= 1 and (r.score == 1 or not own)
    assert Counter(r.doc_id for r in out).most_common(1)[0][1] == 1


def test_passing_tables_are_deleted(spark):
    """What op2, op5 and the mixing stage store on the way is gone before the next stage; their lists, classes and blocks were left until the session ended."""
    from docspark.llm import stages
    from docspark.llm.common import shared_dir
    from docspark.llm.op2_line_dedup import line_dedup
    from docspark.llm.op5_ngram_join import ngram_components

    at = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    rows = [(i, f"a b c d e f g h i j k{i % 3}\nsome line of words number {i % 4}", "xyz"[i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for make, kept in [(line_dedup, {"removed", "repeated"}), (ngram_components, {"components"}), (stages.mix_sources, {"numbered", "copies"})]:
        before = set(os.listdir(at))
        assert make(df).count() > 0
        assert {x.split("-")[1] for x in set(os.listdir(at)) - before if x.startswith("docspark-")} == kept


def test_op2_lists_in_any_number_of_passes(spark, monkeypatch):
    from docspark.llm import op2_line_dedup as op2

    rng = random.Random(5)
    lines = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(5, 9))] for _ in range(30)]
    rows = [(i, "\n".join(" ".join([*rng.choice(lines), *[f"n{i}"] * rng.randint(0, 1)]) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for passes in (1, 3):
        monkeypatch.setattr(op2, "PASSES", passes)
        found.append(sorted(tuple(r) for r in op2.line_dedup(df).collect()))
    assert found[0] == found[1] and any(r[2] for r in found[0])


def test_op2_splits_a_text_once(spark):
    """The lines that stay were taken from a new split of the text for each of them."""
    from docspark.llm.op2_line_dedup import line_dedup

    lines = [f"line{i} a b c" for i in range(3000)]
    df = spark.createDataFrame([(1, "\n".join([*lines, "line5 a b c"]), 0), (2, "line7 a b c\nother", 0), (3, None, 0)], "doc_id long, text string, _lines int")
    out = line_dedup(df)
    assert "get(split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(1, "\n".join(lines), 0, 1, 3001), (2, "other", 0, 1, 2), (3, None, 0, 0, 0)}


def test_op2_short_lists_go_to_the_join_at_once(spark, monkeypatch):
    """Sets of lists with LONG sets at most met their neighbours, too, which the join pairs anyway; the join gives each pair once."""
    from docspark.llm import op2_line_dedup as op2

    base = [[f"w{j}x{i}" for i in range(12)] for j in range(30)]
    rows = [(4 * j + k, " ".join([*words, f"n{k}"])) for j, words in enumerate(base) for k in range(4)]
    df = spark.createDataFrame([*rows, (None, " ".join([*base[0], "late"])), (200, " ".join([*base[0], "later"]))], "doc_id long, text string").repartition(3)
    near, opened, old_near, old_open = [], [], op2._near_pairs, op2._open_pairs

    def noted(old, to):
        def note(*args):
            out = old(*args)
            to.append([tuple(r) for r in out.collect()])
            return out

        return note

    monkeypatch.setattr(op2, "_near_pairs", noted(old_near, near))
    monkeypatch.setattr(op2, "_open_pairs", noted(old_open, opened))
    got = {r.doc_id: r.removed_lines for r in op2.line_dedup(df).collect()}
    assert got == {i: int(i % 4 > 0) for i, _ in rows} | {None: 1, 200: 1}
    assert near == [[]]
    pairs = {p for found in opened for p in found}
    assert all(x < y for x, y in pairs) and len(pairs) == 29 * 6 + 15


def test_op2_a_family_meets_its_neighbours(spark, monkeypatch):
    """Each member of a family met LEADERS others in each of its lists; now NEAR, and few members are left for the join of the lists."""
    from docspark.llm import op2_line_dedup as op2

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.sample(base, 58), f"x{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near, opened, old_near, old_open = [], [], op2._near_pairs, op2._open_pairs

    def counted(old, to):
        def count(*args):
            out = old(*args)
            to.append(out.count())
            return out

        return count

    monkeypatch.setattr(op2, "_near_pairs", counted(old_near, near))
    monkeypatch.setattr(op2, "_open_pairs", counted(old_open, opened))
    got = {r.doc_id: r.removed_lines for r in op2.line_dedup(df).collect()}
    assert got == {i: int(i > 0) for i, _ in rows}
    assert 399 <= near[0] <= op2.NEAR * len(op2.PROBES) * 400
    assert sum(opened) < 20 * 400


def test_op5_a_pair_meets_once(spark, monkeypatch):
    """Sets near the threshold share many rare shingles; the join must not give a row for each of them."""
    from docspark.llm import op5_ngram_join as op5

    rng, rows = random.Random(11), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(300)]
        for j in range(30):
            words = list(base)
            for at in rng.sample(range(300), rng.randint(3, 8)):
                words[at] = f"x{family}_{j}_{at}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, met = [], op5._met

    def counted(labelled, percent):
        out = met(labelled, percent)
        seen.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(op5, "_met", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5.ngram_components(df).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    names = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and names[a] != names[b]:
                low, high = sorted((names[a], names[b]))
                names = [low if n == high else n for n in names]
    assert got == {i: (len(sets[i]), names[i]) for i in range(len(rows))}
    assert len(set(names)) > 3
    [(made, distinct)] = seen
    assert 0 < distinct <= made <= 3 * distinct


def test_op12_memo_holds_slots_of_short_matches(monkeypatch):
    """Ids are gathered from arrays, not from a list object for each match; long matches leave nothing behind, and a memo that is full starts again."""
    import tiktoken

    from docspark.llm import op12_duckdb_bpe as op12

    monkeypatch.setattr(op12, "CACHE", 60)
    with open(op12.default_ranks(), "rb") as f:
        database = op12.Database(op12.ranks_of(f.read(), op12.default_pattern()))
    library = tiktoken.Encoding("test", pat_str=op12.default_pattern(), mergeable_ranks={b: i for i, b in database.ranks.tokens.items()}, special_tokens={})
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcxyzéß", k=n))
    for _ in range(6):
        texts = ["", " ", *[" ".join(word(rng.choice([1, 3, 9, 20, 200])) for _ in range(rng.randint(0, 12))) for _ in range(8)], word(5000)]
        ids = database.encode(texts)
        assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
        assert database.decode(ids) == [t.encode() for t in texts]
        assert all(isinstance(slot, int) and len(w.encode()) <= op12.SHORT for w, slot in database.memo.items())
        assert sorted(database.memo.values()) == list(range(len(database.begin) - 1)) and database.begin[-1] == len(database.pool)
    assert database.encode([]) == []
