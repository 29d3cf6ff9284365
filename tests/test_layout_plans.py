"""Words of a text lie by document already: what is sorted and grouped by document shuffles the texts, not the words."""

from docspark.plans.registry import QUERIES


def exchanges(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_tags_are_not_shuffled(spark):
    found = exchanges(spark, "x36_decoded_fields")
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]


def test_words_of_features_are_not_shuffled(spark):
    """The rest are the tables of documents and of those that could be read."""
    found = exchanges(spark, "l07_feature_table")
    assert sum("ENSURE_REQUIREMENTS" in x for x in found) <= 6 < len(found)


def test_topics_count_terms_once(spark, monkeypatch):
    """All numbers of topics are fitted on one table of counts."""
    from docspark.operators import features as X
    from docspark.plans import models as P

    made, tables = [], []
    monkeypatch.setattr(P.X, "topic_counts", lambda *a, f=X.topic_counts: made.append(1) or f(*a))
    monkeypatch.setattr(P.X, "topics_of_counts", lambda t, *a: tables.append(t) or (_ for _ in ()).throw(ValueError("not fitted here")))
    try:
        P.m11_topic_count(spark, "/root/testdata/sf0.001")
    except RuntimeError as e:
        assert "not fitted here" in str(e)
    assert len(made) == 1 and len(tables) == 4 and len(set(map(id, tables))) == 1
