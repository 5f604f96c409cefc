import pytest
from pyspark.sql import functions as F

from moderata.operators import classify, encode, logistic, retrieval, terms
from moderata.session import settle

ROWS = [(1, "a b a", "x", 1), (2, "b c", None, 0), (3, None, "y", 1), (4, "", "z", 0), (5, "c c c a", "x", 0)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "id bigint, text string, lang string, label int")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_term_table(docs):
    table = terms.term_table(docs, "id", carry=["label"])
    got = {r.id: r.terms and [tuple(t) for t in r.terms] for r in table.collect()}
    assert got == {1: [("a", 2), ("b", 1)], 2: [("b", 1), ("c", 1)], 3: None, 4: [], 5: [("a", 1), ("c", 3)]}
    joined = terms.term_table(docs, "id", ["lang", "text"])
    assert [tuple(t) for t in joined.where("id = 3").first().terms] == [("y", 1)]


def test_operators_give_the_same_from_texts_and_from_the_table(docs):
    table = terms.term_table(docs, "id", carry=["label"])
    assert rows(retrieval.idf_table(docs)) == rows(retrieval.idf_table(table, ["terms"]))
    idf = settle(retrieval.idf_table(docs))
    vectors = [retrieval.tfidf_vectors(docs, "id", idf), retrieval.tfidf_vectors(table, "id", idf, ["terms"])]
    entries = [v.select("id", F.sort_array(F.arrays_zip("terms", "weights")).alias("e")) for v in vectors]
    assert rows(entries[0]) == rows(entries[1])
    assert rows(encode.build_vocabulary(docs)) == rows(encode.build_vocabulary(table, "terms"))
    models = [settle(classify.train_naive_bayes(docs)), settle(classify.train_naive_bayes(table, "terms"))]
    assert rows(models[0]) == rows(models[1])
    scored = [classify.score_naive_bayes(d, models[0], "id", t) for d, t in ((docs, "text"), (table, "terms"))]
    assert rows(scored[0]) == rows(scored[1])
    weights = [logistic.train(docs, "id"), logistic.train(table, "id", "terms")]
    assert rows(weights[0]) == rows(weights[1])


def test_labels_other_than_0_and_1_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "id bigint, text string, label int")
    with pytest.raises(Exception, match="must be 0 or 1"):
        classify.train_naive_bayes(docs)
