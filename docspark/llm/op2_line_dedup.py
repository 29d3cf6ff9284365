r"""Line dedup by an exact set-similarity join.

A line is its set of words. A line is removed when an earlier line (by document id, then line number) has the same set, or a
set of Jaccard similarity PERCENT or more; whether the earlier one is itself removed does not matter, so the result depends
on no order of work. Lines without words stay.

Words of a line are ordered by rarity. Similar sets of n words share one of their n - ceil(t n) + 1 rarest (prefix filter);
only these are shuffled, as short rows, one per distinct set and word. Sets of fewer than four words (at 80 percent) are similar to equal
sets only, so they go no further. Pairs that meet in a word pass the length filter, the positional filter (what can still
follow in both sets), and a lossless bound on parity bitmaps (64 bits, 128 above HALF words, 256 above WIDE); what is left
is verified on the words themselves.

Families of many similar lines must not become all their pairs: first each set meets only the NEAR sets before it in lists at PROBES, each of one
size band and part, in the order of the word beside the list's own, then of documents: members of a family stand side by side there, and all but the first of them are settled.
Lists that LONG sets of a band at most look at are left out of this: the join pairs what is similar in them, and costs less there. Then one join
of the lists with themselves pairs sets that are not settled with all others; both of its sides read one shuffle. It takes the lists in PASSES parts,
one after the other, so that the lists of one part only lie on disk at a time; tables of a round are deleted when it is done.

Rarity needs no shuffle of words: counts of occurrences by hash bucket, combined in each map task, fill a table of fixed size. It only
steers the order, any order gives the same result. Sets are named by 128 bits over 56-bit hashes of their words.

Cases: a null text has no lines and stays null. Null ids come last; of rows with equal ids and different texts the order is that
of a hash of the text. Of rows that repeat with the same id and text one (by a hash of all columns) comes first: it is judged
as the document, the others lose every line with words. A document whose lines are all removed keeps an empty text. Other
columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import documents, fresh, stored, stored_alone, text_of
from docspark.llm.op8_exact_dedup import bit_filter, let_through

PERCENT = 80
#: Buckets of the rarity table.
TABLE = 1 << 18
#: Places of a set's prefix whose lists the first round looks at, as a share of its end and so many before (words that a copy adds are rare and come first, so
#: families meet at the end); how far sizes in one of its bands differ; parts of a list, dealt by set and place, so that no list is one task's; sets that each set meets there.
PROBES, BAND, PARTS, NEAR = ((1.0, 0), (1.0, 1), (1.0, 2), (0.75, 0), (0.5, 0), (0.0, 0)), 1.25, 8, 2
#: Lists at which more sets of one size band than this look are looked at in the first round.
LONG = 32
#: Parts of the lists, by word, that are joined one after the other.
PASSES = 2
#: Sets of more words carry bitmaps of 128 and of 256 bits.
HALF, WIDE = 64, 160
BITMAPS = ("b", "b1", "b2", "b3")
ODD = "\t\x0b\f\r"
HAS_WORD = r"[^\x20\x09-\x0D]"


def _plain(text: Column) -> Column:
    """White space within lines as single characters of one kind, for splits without a pattern."""
    odd = reduce(lambda a, b: a | b, [text.contains(c) for c in ODD])
    return F.when(odd, F.translate(text, ODD, " " * len(ODD))).otherwise(text)


def line_words(line: Column) -> Column:
    """Words of a plain line."""
    words = F.split(line, " ")
    loose = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    return F.when(loose, F.array_remove(words, "")).otherwise(words)


def _lines(rows: DataFrame) -> DataFrame:
    """row, doc_id, at (line number), line."""
    return rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def _rarity(rows: DataFrame) -> list[int]:
    """By bucket of a word's hash, 4 log2 of how often its words occur in plain texts; one scan, at most TABLE rows of two numbers to the driver."""
    words = rows.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(TABLE - 1)).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    table = [0] * TABLE
    for b, n in zip(counts.column("b").to_pylist(), counts.column("n").to_pylist(), strict=True):
        table[b] = min(126, int(4 * log2(n)))
    return table


def min_size(percent: int) -> int:
    """Sets of fewer words are similar to equal sets only: one word more is too much."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 30


def _sets(lines: DataFrame, table: list[int], percent: int) -> DataFrame:
    """Of plain lines: row, doc_id, at, s1, s2 (name the set), n, BITMAPS, prefix (int keys of the rarest words, rarest first; null for short sets)."""
    step = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one array
    hashes = F.array_distinct(F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)))
    one, mask = F.lit(1).cast("long"), F.lit(TABLE - 1)
    # the step of rarity before 56 bits of the hash: sorted, these give the order and the set
    ordered = F.transform("h", lambda h: F.shiftleft(F.coalesce(step[h.bitwiseAND(mask)], F.lit(0).cast("long")), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1))))
    df = lines.filter(F.ltrim("line") != "").select("row", "doc_id", "at", hashes.alias("h")).select("row", "doc_id", "at", F.sort_array(ordered).alias("t"))
    n = F.size("t")
    # few steps a word: shiftleft takes the last six bits of the place itself
    fold = lambda on: F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", on(x), F.hash(x))))
    low = lambda x: x.bitwiseAND(one)
    # the parity of all words, of those whose hash has bit 0, bit 1, and both: 64, 128 and 256 bits that compare sets of any sizes
    halves = [fold(low), fold(lambda x: low(F.shiftright(x, 1))), fold(lambda x: low(F.shiftright(x, 1).bitwiseAND(x)))]
    bitmaps = [fold(lambda x: one).alias("b"), *[F.when(n > most, h).alias(b) for h, b, most in zip(halves, BITMAPS[1:], (HALF, WIDE, WIDE), strict=True)]]
    prefix = F.transform(F.slice("t", 1, (n + F.floor(-percent * n / 100) + 1).cast("int")), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    return df.select("row", "doc_id", "at", F.xxhash64("t").alias("s1"), F.xxhash64(F.lit(1), "t").alias("s2"), n.alias("n"), *bitmaps, F.when(n >= min_size(percent), prefix).alias("prefix"))


def _need(percent: int) -> Column:
    return F.ceil(percent * (F.col("xn") + F.col("yn")) / F.lit(100 + percent) - 1e-9)


def _possible(percent: int, first: bool) -> Column:
    """Length, positional and bitmap filters for sets x and y that share a word at places xi and yi of their order. first: the pair need pass at its first common word only, before which nothing is shared."""
    ahead = F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi")) + (F.lit(0) if first else F.least("xi", "yi"))
    length = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent
    d, h, w, q = (F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}")) for b in BITMAPS)
    wide = F.bit_count(d.bitwiseXOR(h).bitwiseXOR(w).bitwiseXOR(q)) + F.bit_count(h.bitwiseXOR(q)) + F.bit_count(w.bitwiseXOR(q)) + F.bit_count(q)
    differ = F.coalesce(wide, F.bit_count(d.bitwiseXOR(h)) + F.bit_count(h), F.bit_count(d))
    return length & (ahead >= _need(percent)) & (differ <= F.col("xn") + F.col("yn") - 2 * _need(percent))


def _verify(pairs: DataFrame, first: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """sid of the later set of each pair (x, y) that is similar, by the words of a line that has the set; only texts that have such a line are split."""
    nodes = stored(pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), "nodes")
    asked = first.filter(let_through(bit_filter(nodes.select(F.col("sid").alias("key"))), F.col("sid"))).select("sid", "ord")
    place = stored(asked.join(nodes, "sid", "left_semi").withColumn("key", F.xxhash64("ord.row", "ord.at")), "places")
    asked_rows = rows.filter(let_through(bit_filter(place.select(F.col("ord.row").alias("key"))), F.col("row")))
    found = _lines(asked_rows).withColumn("key", F.xxhash64("row", "at")).filter(let_through(bit_filter(place.select("key")), F.col("key")))
    same_place = (place["key"] == found["key"]) & (F.col("ord.row") == found["row"]) & (F.col("ord.at") == found["at"]) & F.col("ord.id").eqNullSafe(found["doc_id"])
    words = found.join(place, same_place).groupBy("sid").agg(F.first("ord").alias("ord"), F.first("line").alias("line"))
    words = stored(words.select("sid", "ord", F.array_distinct(line_words(F.col("line"))).alias("w")), "words")
    x = words.select(F.col("sid").alias("x"), F.col("ord").alias("xo"), F.col("w").alias("xw"))
    y = words.select(F.col("sid").alias("y"), F.col("ord").alias("yo"), F.col("w").alias("yw"))
    # common words of 100 + percent make up percent of both sizes; written so that words are compared once
    same = pairs.join(x, "x").join(y, "y").filter(F.size(F.array_intersect("xw", "yw")) * (100 + percent) >= percent * (F.size("xw") + F.size("yw")))
    return same.select(F.when(F.col("xo") < F.col("yo"), F.col("y")).otherwise(F.col("x")).alias("sid")).distinct()


def _in_passes(pairs: Callable[[Column], DataFrame]) -> DataFrame:
    """The pairs of all lists; each call gets the condition that tells the lists of its pass by their word t."""
    parts = [stored(pairs(F.pmod("t", F.lit(PASSES)) == i), "pairs") for i in range(PASSES)]
    return reduce(DataFrame.unionByName, parts).distinct()


def _postings(sets: DataFrame, *columns: Column) -> DataFrame:
    return sets.filter("prefix IS NOT NULL").select("sid", "n", *BITMAPS, *columns, F.posexplode("prefix").alias("i", "t"))


def _near_pairs(first: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of each set y and the NEAR sets x before it in lists of y at PROBES with more than LONG sets of a band."""
    end = F.size("prefix") - 1
    probed = first.filter("prefix IS NOT NULL").withColumn("i", F.explode(F.array_distinct(F.array(*[F.greatest(F.floor(end * share).cast("int") - less, F.lit(0)) for share, less in PROBES]))))
    probed = probed.withColumns({"t": F.get("prefix", F.col("i")), "band": F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))).cast("int")}).withColumn("key", F.xxhash64("t", "band"))
    probed = probed.filter(let_through(bit_filter(probed.groupBy("key").count().filter(F.col("count") > LONG)), F.col("key")))
    beside, part = F.get("prefix", F.when(F.col("i") > 0, F.col("i") - 1).otherwise(1)), F.pmod(F.xxhash64("sid", "i"), F.lit(PARTS))
    probed = probed.select("t", "band", part.alias("part"), beside.alias("beside"), F.col("ord.id").alias("o"), F.col("sid").alias("y"), *[F.col(c).alias(f"y{c}") for c in ("n", *BITMAPS, "i")])
    order = Window.partitionBy("t", "band", "part").orderBy("beside", "o", "y")
    x = F.struct(F.col("y").alias("x"), *[F.col(f"y{c}").alias(f"x{c}") for c in ("n", *BITMAPS, "i")])
    near = probed.select("y", *[f"y{c}" for c in ("n", *BITMAPS, "i")], F.array(*[F.lag(x, k).over(order) for k in range(1, NEAR + 1)]).alias("near"))
    return near.withColumn("x", F.explode("near")).select("y", *[f"y{c}" for c in ("n", *BITMAPS, "i")], "x.*").filter(_possible(percent, False)).select("x", "y").distinct()


def _marked(first: DataFrame, settled: DataFrame) -> DataFrame:
    """sid, n (negative if the set is settled), BITMAPS, o (id of its document), prefix."""
    first = first.filter("prefix IS NOT NULL").select("sid", "n", *BITMAPS, F.col("ord.id").alias("o"), "prefix")
    maybe = let_through(bit_filter(settled.select(F.col("sid").alias("key"))), F.col("sid"))
    asked = first.filter(maybe).join(settled.withColumn("is", F.lit(True)), "sid", "left").withColumn("n", F.when(F.col("is"), -F.col("n")).otherwise(F.col("n"))).drop("is")
    return stored(asked, "marked").unionByName(first.filter(~maybe))


def _open_pairs(marked: DataFrame, percent: int, part: Column) -> DataFrame:
    """Pairs (x, y) in a list, each once, of which the one of the later document (of one document: one of both) is not settled. The condition needs both sides' marks, so both read one shuffle of the lists."""
    lists = _postings(marked, F.col("o")).filter(part)
    side = lambda p: lists.select("t", F.abs("n").alias(f"{p}n"), F.col("n").alias(f"{p}m"), F.col("sid").alias(p), *[F.col(c).alias(f"{p}{c}") for c in ("o", *BITMAPS, "i")])
    up_to = lambda a, b: F.coalesce(F.col(a) <= F.col(b), F.col(b).isNull())
    unsettled = ((F.col("ym") > 0) & up_to("xo", "yo")) | ((F.col("xm") > 0) & up_to("yo", "xo"))
    return side("x").join(side("y"), "t").filter((F.col("x") < F.col("y")) & _possible(percent, True) & unsettled).select("x", "y").distinct()


def removed_lines(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, at: the lines of rows (row, doc_id, text) to remove."""
    rows = rows.withColumn("text", _plain(F.col("text")))
    sets = stored(_sets(_lines(rows), _rarity(rows), percent), "sets")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"), F.col("at").alias("at"))
    # of equal sets the first line stands for all; the combiner keeps one row of a set in each task
    first = sets.groupBy("s1", "s2").agg(F.min(rank).alias("ord"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in BITMAPS], F.first("prefix").alias("prefix"), F.count("*").alias("copies"))
    first = stored(first.withColumn("sid", F.monotonically_increasing_id()), "first")
    spark = rows.sparkSession
    settled = stored_alone(spark, lambda: _verify(stored_alone(spark, lambda: _near_pairs(first, percent), "pairs"), first, rows, percent), "settled")

    def open_pairs() -> DataFrame:
        marked = _marked(first, settled)
        return _in_passes(lambda part: _open_pairs(marked, percent, part))

    rest = stored_alone(spark, lambda: _verify(stored_alone(spark, open_pairs, "pairs"), first, rows, percent), "rest")
    similar = stored(settled.unionByName(rest).distinct().withColumn("similar", F.lit(True)), "similar")
    fate = first.select("sid", "s1", "s2", "ord", "copies").join(similar, "sid", "left").filter("similar OR copies > 1").select("s1", "s2", "ord", F.coalesce("similar", F.lit(False)).alias("similar"))
    own = sets.select("row", "doc_id", "at", "s1", "s2").join(fate, ["s1", "s2"])
    same = F.col("ord.id").eqNullSafe(F.col("doc_id")) & (F.col("ord.row") == F.col("row")) & (F.col("ord.at") == F.col("at"))
    return own.filter(F.col("similar") | ~same).select("row", "doc_id", "at")


def _repeats(table: DataFrame, row: str, number: str) -> tuple[DataFrame, DataFrame]:
    """table without rows that repeat an id and text, and these: all but the first (by a hash of all columns) of each group."""
    groups = stored(table.groupBy(row, "doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "repeated")
    if groups.isEmpty():
        return table, table.limit(0)
    maybe = let_through(bit_filter(groups.select(F.col("row").alias("key"))), F.col(row))
    asked = table.filter(maybe).join(groups, (F.col(row) == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    asked = stored(asked.select(*table.columns, F.when(F.col("row").isNotNull(), F.struct(F.xxhash64(*[table[c].cast("string") for c in table.columns]).alias("h"), F.monotonically_increasing_id().alias("n"))).alias(number)), "repeats")
    leads = asked.filter(F.col(number).isNotNull()).groupBy(F.col(row).alias("row"), F.col("doc_id").alias("id")).agg(F.min(number).alias("lead")).select(F.col("lead.n").alias("lead"))
    later = asked.filter(F.col(number).isNotNull()).join(leads, F.col(f"{number}.n") == F.col("lead"), "left_anti")
    once = asked.filter(F.col(number).isNull()).unionByName(asked.join(leads, F.col(f"{number}.n") == F.col("lead"), "left_semi"))
    return table.filter(~F.coalesce(maybe, F.lit(True))).unionByName(once.drop(number)), later.drop(number)


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text and more) with the lines removed, and columns removed_lines and total_lines (renamed if taken)."""
    row, gone, total, number, key, name, parts = fresh(docs, "_row", "removed_lines", "total_lines", "_number", "_key", "_name", "_lines")
    table = docs.withColumn(row, F.xxhash64(F.col("text")))

    def by_document() -> DataFrame:
        removed = removed_lines(table.select(F.col(row).alias("row"), "doc_id", "text"), percent)
        per = removed.groupBy("row", "doc_id").agg(F.collect_set("at").alias(gone))  # at most the lines of one document
        return per.withColumnsRenamed({"row": key, "doc_id": name})

    per = stored_alone(docs.sparkSession, by_document, "removed")
    lines = F.col(parts)  # a column of its own: written out, the text would be split again for each of its lines
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    all_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    numbers = [count.alias(gone), F.coalesce(all_lines, F.lit(0)).cast("long").alias(total)]
    result = [*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], *numbers]
    once, later = _repeats(table, row, number)
    # documents that surely lose nothing need not be shuffled
    maybe = let_through(bit_filter(per.select(F.col(key).alias("key"))), F.col(row))
    touched = once.filter(maybe).join(per, (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(name)), "left")
    worded = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull())
    changed = touched.unionByName(later.withColumn(gone, F.when(F.size(worded) > 0, worded)), allowMissingColumns=True).withColumn(parts, F.split(F.col("text"), "\n")).select(*result)
    return changed.unionByName(once.filter(~maybe).withColumn(gone, F.lit(None).cast("array<int>")).select(*docs.columns, *numbers))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, and the digest of the text that is left (null: empty)."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("total_lines").alias("n_lines"), F.col("removed_lines").alias("n_removed"), F.sha2(text_of("text").cast("binary"), 256).alias("kept_sha256"))
