"""The classifiers' training sample is bounded in rows, and workers let go of their word tables."""

from tidelab.llm import tokens
from tidelab.llm.labelled import training_sample


def test_rows_that_share_an_id_count_once(spark):
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('copy ', id) AS text").unionByName(
        spark.createDataFrame([(i, f"text {i}") for i in range(2, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    rows, _ = training_sample(docs, labels, "toxic", 4, 5, 100)
    got = rows.collect()
    assert len(got) == 59 and len({r["doc_id"] for r in got}) == 59
    again = {r["doc_id"]: r["text"] for r in training_sample(docs.repartition(7), labels, "toxic", 4, 5, 100)[0].collect()}
    assert {r["doc_id"]: r["text"] for r in got} == again
    few, _ = training_sample(docs, labels, "toxic", 4, 5, 10)
    assert few.count() == 20


def test_rows_without_text_or_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows, _ = training_sample(docs, labels, "toxic", 4, 5, 10)
    assert [(r["doc_id"], r["text"], r["label"]) for r in rows.collect()] == [(1, "", 1)]
    assert training_sample(docs, labels.limit(0), "toxic", 4, 5, 10)[0].count() == 0


def test_release_forgets_encoders():
    from tidelab.llm.queries import vocabulary

    one = tokens.encoder(vocabulary("byte_bpe_50k.json"), "bytes")
    assert tokens.encoder(vocabulary("byte_bpe_50k.json"), "bytes") is one
    tokens.release()
    assert tokens.encoder(vocabulary("byte_bpe_50k.json"), "bytes") is not one
