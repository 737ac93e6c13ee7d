"""The classifiers on held-out rows, decontamination against plain search, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelab.llm import decontam, quality, toxicity
from tidelab.llm.labelled import fit_platt

SF01 = "/root/testdata/sf0.1"
SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held(rows, labels, column):
    got = rows.where("held_out").join(labels, "doc_id").where(f"{column} is not null").select("score", "predicted", column).collect()
    return np.array([r.score for r in got]), np.array([r.predicted for r in got]), np.array([r[column] for r in got])


def test_quality_held_out(labelled, odd_documents, no_documents):
    docs, labels = labelled
    model = quality.train(docs, labels)
    score, predicted, label = held(quality.score_quality(docs, model), labels, "quality")
    assert auc(score, label) > 0.98 and (predicted == label).mean() > 0.98
    rows = quality.score_quality(odd_documents, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.score_quality(no_documents, model).count() == 0


def test_toxicity_held_out(labelled, odd_documents, no_documents):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    score, predicted, label = held(toxicity.score_toxicity(docs, model), labels, "toxic")
    assert auc(score, label) > 0.93 and (predicted == label).mean() > 0.96
    rows = toxicity.score_toxicity(odd_documents, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(no_documents, model).count() == 0
    kept = toxicity.reject_toxic(odd_documents, model)
    assert kept.schema == odd_documents.schema


def test_training_without_both_classes(spark, documents):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(documents, quality.train(documents, none)).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(documents, toxicity.train(documents, none)).select("score").distinct().count() == 1


def test_labels_that_tell_nothing_reject_nothing(spark, documents):
    one_class = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    few = spark.createDataFrame([(0, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    for labels in (one_class, few):
        assert toxicity.reject_toxic(documents, toxicity.train(documents, labels)).count() == documents.count()


def test_machine_learns_pairs():
    """Two terms that are harmless alone and toxic together: no sum of weights can tell."""
    rng = np.random.default_rng(0)
    rows = [sorted({int(a) for a in rng.choice(2, rng.integers(0, 3), replace=False)} | {int(rng.integers(2, 9))}) for _ in range(3000)]
    label = np.array([int({0, 1} <= set(r)) for r in rows])
    w, v, bias = toxicity.fit_machine(rows, label, np.ones(len(rows)), 9)
    model = toxicity.Model({i: i for i in range(9)}, w, v, bias, 1.0, 0.0)
    assert np.mean([(model.score(r) >= 0.5) == y for r, y in zip(rows, label, strict=True)]) > 0.99


def test_rare_insults_and_harmless_words_toxic_together_are_learned(spark):
    """Insults in under 5% of the toxic rows and in no other; two words neutral alone, toxic together."""
    rnd = random.Random(21)
    more = {3: ["blick", "norfa"], 4: ["blick"], 5: ["norfa"], 6: [], 7: []}
    rows = []
    for i in range(2400):
        words = [f"word{rnd.randrange(300)}" for _ in range(20)] + more.get(i % 8, [f"insult{rnd.randrange(16)}"])
        rows.append((i, " ".join(rnd.sample(words, len(words))), int(i % 8 < 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    terms = {w: toxicity.crc32(w.encode()) & toxicity._MASK for w in ["blick", "norfa", *(f"insult{k}" for k in range(16))]}
    assert all(t in model.rows for t in terms.values())
    got = toxicity.score_toxicity(df, model).where("held_out").join(df, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97


def test_pairs_tell_where_words_do_not():
    p = toxicity.likelihood_ratio(np.array([100.0, 50.0]), np.array([0.0, 50.0]), 8000, 8000)
    assert p[0] > 16 and abs(p[1]) < 1e-6


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(400)]
    label = np.array([int((r < 25).sum() * 2 > len(r)) for r in rows])
    scale = np.where(np.arange(50) < 25, 1.0, -1.0)
    w, bias = quality.dual_coordinate_descent(rows, scale, label, np.full(400, 4.0), rounds=40)
    margin = np.array([w[r] @ scale[r] / np.sqrt(len(r)) + bias for r in rows])
    assert ((margin > 0) == (label == 1)).mean() > 0.97


def test_platt_is_monotone_and_finite():
    a, b = fit_platt(np.array([-30.0, -29, 28, 30]), np.array([0, 0, 1, 1]), np.ones(4))
    assert np.isfinite([a, b]).all() and a > 0


def test_leaks_hold_all_verbatim_copies(spark):
    docs, items = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).where("score = 1").collect()}
    want = {
        (r.doc_id, r.item_id)
        for r in docs.join(items.withColumnRenamed("text", "item"), F.col("text").contains(F.col("item"))).select("doc_id", "item_id").collect()
    }
    assert want <= got and len(got) <= len(want) + 3


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontam.align(a, b)[0] == brute_align(a, b)


def test_edited_copies_and_odd_rows(spark, odd_documents):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(40) for _ in range(20)]
    rows = []
    for i, item in enumerate(items):
        edited = [w for k, w in enumerate(item) if k % 11 != 10]
        edited = [rnd.choice(vocabulary) if k % 8 == 7 else w for k, w in enumerate(edited)]
        rows.append((i, " ".join([*text(60), *edited, *text(60)]), 0))
        rows.append((100 + i, " ".join(text(200)), 0))
    rows += [(500 + i, " ".join([*text(3), *items[0], *text(3)]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(items)] + [(77, None), (78, ""), (79, "too short"), (80, " ".join(items[3]))],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, block_words=300).collect()}
    want = {(i, i) for i in range(20)} | {(500 + i, 0) for i in range(300)} | {(3, 80)}
    assert got == want
    kept = decontam.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {100 + i for i in range(20)}
    assert decontam.find_leaks(odd_documents, bench).count() == 0
    assert decontam.drop_leaked(odd_documents, bench.where("false")).count() == odd_documents.count()


def test_edited_copies_keep_seeds_in_small_and_hot_tables(spark):
    """Short intact runs between changed words, in few documents and in nearly all of them."""
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    items = [text(40) for _ in range(9)]
    edited = [[f"x{k}" if k % (5 + i % 3) == 4 else w for k, w in enumerate(t)] for i, t in enumerate(items)]
    rows = [(i, " ".join([*text(30), *t, *text(30)])) for i, t in enumerate(edited)]
    rows += [(100 + i, " ".join([*text(9), *edited[0], *text(9)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(9)} | {(100 + i, 0) for i in range(200)}
    assert decontam.drop_leaked(docs, bench).count() == 0


def test_phrases_are_no_leaks_and_short_items_are_found(spark):
    items = {
        1: "What is the capital of the old northern kingdom?", 2: "what is the capital of Peru",
        3: "Name all seven of the great rivers that cross this wide and very flat land today", 4: "photosynthesis", 5: "Mount Everest",
        6: "the red planet",
    }
    docs = {
        10: "people often ask what is the capital of a country and get no answer",
        11: "we saw seven of the great rivers that bend near towns",
        12: "so what is the capital of peru they asked", 13: "what is the capital of the cold northern kingdom",
        14: "plants live by photosynthesis alone, photosynthesis", 15: "He climbed Mount Everest", 16: "mount of the red old planet the everest",
        17: "on THE red planet",
    }
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.first_word, r.last_word) for r in decontam.find_leaks(docs, bench).collect()}
    assert {r[:2] for r in got} == {(12, 2), (13, 1), (14, 4), (15, 5), (17, 6)}
    assert {(14, 4, 3, 3), (15, 5, 2, 3), (17, 6, 1, 3)} <= got
    assert {r.doc_id for r in decontam.drop_leaked(docs, bench).collect()} == {10, 11, 16}


def test_shared_words_of_the_best_alignment():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert decontam.shared_words(a, a) == 6 and decontam.shared_words(a, np.array([9, 1, 2, 9, 4, 5, 6])) == 5
    assert decontam.shared_words(a, np.array([8, 9])) == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "simhash_dedup", "decontamination", "secret_scan", "packing"]
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, SF001)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    rows = p.run(spark, SF001).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert {"op4_embeddings", "op11_collocations"} <= set(e.oracle_sql())
