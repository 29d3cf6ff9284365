r"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a ratio of its statistics is above a cutoff. Labelled documents are the holdout: for every
stratum (language), rule and cutoff of a grid, n good documents of which k would be rejected test the hypothesis that the
rule rejects more than a share alpha / rules of good documents. Its exact binomial p-value is P(Bin(n, alpha / rules) <= k).
Multiple testing: Bonferroni's correction over strata and rules asks for p <= delta / (strata * rules); within a rule the
cutoffs are tested in a fixed sequence, from the laxest down, until one fails, which costs no further share of delta (a laxer
cutoff rejects fewer, so the first true hypothesis of the sequence decides). So with probability 1 - delta all rules together
reject at most a share alpha of a stratum's good documents, in all strata at once. Of a rule's cutoffs that pass, the laxest
that rejects at least REACH of what any of them rejects among bad documents is selected; where none rejects a bad document,
or the labels are too few to prove anything (with none rejected, n good ones of (1 - alpha / rules)**n > delta / tests), the
rule rejects nothing in that stratum.

Everything is DataFrame expressions. Statistics of a text are array expressions inside its row (no shuffle); repeated
5-word windows are found by sorting hashes of the windows with their positions, in texts that have any. What is joined with
labels has one short row per document; the selected cutoffs have one row per stratum and rule.

Cases: a null or empty text has no words, so it fails the base rule. A null language is the stratum `und`. Null labels
and labels of unknown documents are not counted. A document is one trial: several labels of an id count as their majority (ties
are left out), and of rows that share an id none is used unless it stands alone. Empty labels select nothing.
Rows with equal or null ids are judged one by one. Columns that documents has besides are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import SPACE, UPPER, documents, fresh, labels, stored, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20
ALPHA, DELTA, REACH = 0.05, 0.05, 0.99
CUTOFFS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rules(s: Column) -> dict[str, Column]:
    """The ratio that each rule bounds, of a struct of statistics."""
    return {
        "symbols": _ratio(s["n_symbols"], s["word_chars"]),
        "dup_lines": _ratio(s["n_dup_lines"], s["n_words"]),
        "repeats": _ratio(s["n_repeat_words"], s["n_words"]),
        "capitals": _ratio(s["n_capitals"], s["word_chars"]),
    }


def with_stats(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """docs with a struct column `out` of STATS (long). Store the result before filtering on it: a filter takes the expressions into itself and computes them again."""
    t, w, h, n = fresh(docs, "_text", "_words", "_windows", "_n")
    df = docs.withColumn(t, text_of(text))
    trimmed = F.btrim(F.col(t), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    df = df.withColumn(n, F.size(w))
    window = lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(WINDOW)])
    df = df.withColumn(h, F.when(F.col(n) >= WINDOW, F.transform(F.sequence(F.lit(0), F.col(n) - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ordered, repeated = fresh(df, "_ordered", "_repeated")
    some = F.size(F.array_distinct(F.col(h))) < F.size(h)
    df = df.withColumn(ordered, F.when(some, F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = lambda x, i: F.coalesce(F.get(F.col(ordered), i)["h"] == x["h"], F.lit(False))
    same = lambda x, i: ((i > 0) & near(x, i - 1)) | near(x, i + 1)
    df = df.withColumn(repeated, F.sort_array(F.transform(F.filter(F.col(ordered), same), lambda x: x["i"])))
    covered = F.aggregate(F.transform(F.col(repeated), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(repeated), i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    less = lambda chars: F.length(t) - F.length(F.translate(F.col(t), chars, ""))
    stats = {
        "n_words": F.col(n),
        "word_chars": F.length(F.translate(F.col(t), " \t\n\x0b\x0c\r", "")),
        "n_symbols": less(SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_capitals": less(UPPER),
    }
    return df.withColumn(out, F.struct(*[c.cast("long").alias(k) for k, c in stats.items()])).drop(t, w, h, n, ordered, repeated)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), the terms added one by one in the logarithm: exact up to rounding, without underflow."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        high = F.greatest(term, a["total"])
        return F.struct(term.alias("term"), (high + F.log(F.exp(term - high) + F.exp(a["total"] - high))).alias("total"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["total"])


def select_cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """stratum, rule, cutoff: of a holdout (stratum, good boolean, s struct of STATS) that passed the base rule. No row: the rule rejects nothing there."""
    ratios = rules(F.col("s"))
    each = holdout.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), r.alias("x")) for k, r in ratios.items()])).alias("r"))
    # one row per stratum, rule and number of cutoffs passed, then cumulative counts over at most len(cutoffs) + 1 rows
    passed = sum((F.when(F.col("r.x") > c, 1).otherwise(0) for c in cutoffs), F.lit(0))
    counts = each.groupBy("stratum", F.col("r.rule").alias("rule"), passed.alias("passed")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    above = counts.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"),
        F.array(*[F.struct(F.lit(c).alias("cutoff"), F.sum(F.when(F.col("passed") > i, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("passed") > i, F.col("bad")).otherwise(0)).alias("hits")) for i, c in enumerate(cutoffs)]).alias("c"),
    )
    share = alpha / len(ratios)
    strata = holdout.select("stratum").distinct().agg(F.count("*"))
    tests = above.select("stratum", "rule", "n", F.explode("c").alias("c")).select("stratum", "rule", "n", "c.*")
    limit = F.log(F.lit(delta)) - F.log(strata.scalar() * len(ratios))
    proven = F.when(F.col("k") < F.col("n") * share, log_tail(F.col("n"), F.col("k"), share) <= limit).otherwise(F.lit(False))
    so_far = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))  # one row a cutoff
    sure = tests.withColumn("sure", F.min(proven).over(so_far)).filter("sure")
    best = sure.groupBy("stratum", "rule").agg(F.max("hits").alias("most"), F.collect_list(F.struct("cutoff", "hits")).alias("all"))
    return best.filter("most > 0").select("stratum", "rule", F.array_max(F.transform(F.filter("all", lambda x: x["hits"] >= REACH * F.col("most")), lambda x: x["cutoff"])).alias("cutoff"))


def stratum_of(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("und"))


def judge(df: DataFrame, stats: str, known: DataFrame, out: str, lang: str = "lang", doc_id: str = "doc_id", **control) -> DataFrame:
    """df (with the struct of statistics) with boolean `out`: kept or not. known: doc_id, quality (1 good, 0 bad)."""
    quality = known.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("q")).filter("q <> 0.5").select("_id", (F.col("q") > 0.5).alias("good"))
    own = df.select(F.col(doc_id).alias("_id"), stratum_of(lang).alias("stratum"), F.col(stats).alias("s"))
    alone = own.join(quality, "_id").groupBy("_id").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("stratum", "s", "good")]).filter("c = 1")
    cutoffs = select_cutoffs(alone.filter(~base_failed(F.col("s"))).select("stratum", "good", "s"), **control)
    key, limits = fresh(df, "_stratum", "_limits")
    per = stored(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(limits)), "cutoffs").withColumnRenamed("stratum", key)
    joined = df.withColumn(key, stratum_of(lang)).join(per, key, "left")
    over = [F.coalesce(r > F.col(limits)[k], F.lit(False)) for k, r in rules(F.col(stats)).items()]
    rejected = base_failed(F.col(stats))
    for x in over:
        rejected = rejected | x
    return joined.withColumn(out, ~rejected).drop(key, limits)


def quality_rules(docs: DataFrame, known: DataFrame, **control) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    stats, kept = fresh(docs, "_stats", "_kept")
    return judge(stored(with_stats(docs, stats), "stats"), stats, known, kept, **control).filter(F.col(kept)).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its statistics, the base rule and the verdict."""
    df = stored(with_stats(documents(spark, sf_dir).select("doc_id", "lang", "text"), "s").select("doc_id", "lang", "s"), "stats")
    return judge(df, "s", labels(spark, sf_dir), "kept").select("doc_id", *[F.col("s")[c].alias(c) for c in STATS[:5]], base_failed(F.col("s")).alias("base_failed"), "kept", "lang", F.col("s")["n_capitals"].alias("n_capitals"))
