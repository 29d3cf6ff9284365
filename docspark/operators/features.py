"""Text features: TF-IDF over word and character n-grams, vocabularies, and models from spark.ml on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import normalized
from docspark.sources.store import spread, stored


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside of higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(w: Column, n: int) -> Column:
    """All runs of n entries of an array, joined by blanks."""
    none = F.array().cast("array<string>")
    return w if n == 1 else F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)


def word_grams(text: Column, lo: int = 1, hi: int = 2) -> Column:
    """n-grams of words of two signs or more, joined by blanks."""
    return let(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_À-ɏ]{2,}"), 0), lambda w: F.concat(*[_joined(w, n) for n in range(lo, hi + 1)]))


def topic_terms(tokens: Column, lo: int = 1, hi: int = 2) -> Column:
    """n-grams of the tokens of two signs or more that are no English stop words (Spark's list); stop words go before neighbours are joined."""
    stop = StopWordsRemover.loadDefaultStopWords("english")
    return let(F.filter(tokens, lambda w: (F.length(w) >= 2) & ~w.isin(stop)), lambda w: F.concat(*[_joined(w, n) for n in range(lo, hi + 1)]))


def char_grams(text: Column, lo: int = 3, hi: int = 5) -> Column:
    """n-grams of signs inside words with a blank at both ends; a word that is shorter gives itself once for each n up to its length, then stops."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        whole = lambda n: F.length(w) >= n
        cut = lambda n: F.when(whole(n), F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        short = F.when(F.length(w) < lo, F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.concat(short, *[cut(n) for n in range(lo, hi + 1)])

    return F.flatten(F.transform(words, of))


def counted(grams: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: each with the number of its places, in the terms' order; the array is sorted and its runs are measured."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda a: F.transform(a, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(a, k + 1), n) - i).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(grams) > 0, let(F.sort_array(grams), runs)).otherwise(none)


def tfidf(docs: DataFrame, grams: Column, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """doc_id, term, weight: (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each document scaled to length 1. With max_features the most frequent terms (by occurrences, then by name) are kept. A row is a document: its terms are counted in the row, the counts are stored once, and read for the terms' frequencies and for the weights, which are shuffled to their document once."""
    counts = stored(spread(docs).select("doc_id", F.explode(counted(grams)).alias("t")).select("doc_id", "t.term", "t.tf"), "counts")
    n = docs.count()
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_features:
        df = df.orderBy(F.desc("total"), "term").limit(max_features)
    w = (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    lists = counts.join(df, "term").groupBy("doc_id").agg(F.collect_list(F.struct("term", w.alias("w"))).alias("t"), F.sqrt(F.sum(w * w)).alias("norm"))
    return lists.select("doc_id", "norm", F.explode("t").alias("x")).select("doc_id", "x.term", (F.col("x.w") / F.col("norm")).alias("weight"))


def vocabulary(docs: DataFrame, tokens: Column, size: int = 30000) -> DataFrame:
    """term, id, n: the most frequent terms from id 2 on; 0 stands for padding, 1 for unknown."""
    counts = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(size - 2)
    return top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "term")) + 1)


def padded(docs: DataFrame, tokens: Column, vocab: DataFrame, length: int = 220) -> DataFrame:
    """doc_id, ids: the first `length` tokens as ids, padded with 0."""
    each = docs.select("doc_id", F.posexplode_outer(F.slice(tokens, 1, length)).alias("pos", "term"))
    known = each.join(vocab.select("term", "id"), "term", "left").withColumn("id", F.coalesce("id", F.lit(1)))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"])
    return known.groupBy("doc_id").agg(ids.alias("ids")).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - F.size("ids")))))


def classifier(train: DataFrame, text: str = "text", label: str = "label", c: float = 1.0, vocab: int = 20000) -> PipelineModel:
    """Logistic regression on counts of words and pairs, classes weighted alike; fitted on the training rows only."""
    n, k = train.count(), train.select(label).distinct().count()
    weights = train.groupBy(label).agg((F.lit(float(n)) / (k * F.count("*"))).alias("_weight"))
    rows = train.join(weights, label).withColumn("_grams", word_grams(normalized(F.col(text))))
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="_grams", outputCol="_x", minDF=2, vocabSize=vocab, binary=True), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", regParam=1.0 / (c * max(n, 1)), maxIter=50)]
    return Pipeline(stages=stages).fit(rows)


def classify(model: PipelineModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns pred_label and probabilities, an array in the order of the model's labels."""
    names = model.stages[0].labels
    rows = docs.withColumn("_grams", word_grams(normalized(F.col(text))))
    indexed = PipelineModel(model.stages[1:]).transform(rows).withColumn("probabilities", vector_to_array("probability"))
    return indexed.withColumn("pred_label", F.element_at(F.array(*map(F.lit, names)), (F.col("prediction") + 1).cast("int"))).select(*docs.columns, "pred_label", "probabilities")


def topic_counts(train: DataFrame, tokens: Column) -> Callable[[DataFrame], DataFrame]:
    """Counts (doc_id, features) of the terms that `fit_topics` takes from the training rows, for any rows (doc_id, and what tokens needs)."""

    def terms(df: DataFrame) -> DataFrame:
        return spread(df).select("doc_id", topic_terms(tokens).alias("_t"))

    counts = CountVectorizer(inputCol="_t", outputCol="features", minDF=3, maxDF=0.95, vocabSize=30000).fit(stored(terms(train), "topic-terms"))
    return lambda df: counts.transform(terms(df)).select("doc_id", "features")


def topics_of_counts(train: DataFrame, k: int = 10, iterations: int = 20, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """`fit_topics` on counts (doc_id, features), which are read again in each iteration (a small table by all cores, since the work is in the iterations); the result takes counts too."""
    model = LDA(k=k, maxIter=iterations, seed=seed, subsamplingRate=1.0, learningDecay=1e-9, learningOffset=1.0, optimizeDocConcentration=False).fit(spread(train))

    def shares(df: DataFrame) -> DataFrame:
        share = model.transform(spread(df)).select("doc_id", vector_to_array("topicDistribution").alias("topics"))
        known = F.aggregate("topics", F.lit(0.0), lambda a, b: a + b) > 0
        return share.withColumn("topics", F.when(known, F.col("topics")).otherwise(F.array_repeat(F.lit(1.0 / k), k)))

    return shares


def fit_topics(train: DataFrame, tokens: Column, k: int = 10, iterations: int = 20, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """Topics of the training rows (doc_id, and what tokens needs); the result gives doc_id and an array of k topic shares that sum to 1 for any rows. A document without known terms has equal shares. Terms are words and pairs that occur in 3 training documents or more and in 95 of 100 at most. Each iteration draws as many documents as there are, and replaces the topics as a batch does."""
    counts = topic_counts(train, tokens)
    shares = topics_of_counts(stored(counts(train), "topic-counts"), k, iterations, seed)
    return lambda df: shares(counts(df))


def topics(docs: DataFrame, tokens: Column, k: int = 10, iterations: int = 20, seed: int = 7, train: DataFrame | None = None) -> DataFrame:
    """doc_id and topic shares of docs, by topics of the training rows, or of docs themselves."""
    return fit_topics(docs if train is None else train, tokens, k, iterations, seed)(docs)
