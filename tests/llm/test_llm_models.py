"""Classifiers on held-out rows, and their parts."""

import numpy as np

from tablelens.llm import quality_model, toxicity


def accuracy(spark, query, label):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select(label, "predicted").collect()


def test_quality_on_held_out_rows(spark):
    rows = accuracy(spark, quality_model.query, "quality")
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.93 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    rows = accuracy(spark, toxicity.query, "toxic")
    assert not any(r["predicted"] and not r["toxic"] for r in rows)
    assert sum(r["predicted"] for r in rows) >= 0.5 * sum(r["toxic"] for r in rows)  # some kinds have two or three labelled rows here


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert np.array_equal(quality_model.word_vectors(docs.repartition(7)), quality_model.word_vectors(docs.coalesce(1)))


def test_clashing_labels_and_repeated_rows_settle_alike_in_any_order(spark):
    docs = spark.createDataFrame([(i, f"good words {i} here") for i in range(120)] + [(5, "another text")], "doc_id bigint, text string")
    rows = [(i, q) for i in range(120) for q in ((0, 1) if i % 2 else (1, 1, 0))]
    models = [quality_model.fit_quality(docs.repartition(3), spark.createDataFrame(r, "doc_id bigint, quality int")) for r in (rows, rows[::-1])]
    assert all(np.array_equal(getattr(models[0], n), getattr(models[1], n)) for n in ("w1", "b1", "w2", "b2", "temperature"))
    one = [(i, q) for i, q in ((i, 1 - i % 2) for i in range(120))]  # the most frequent label, in a tie 0
    plain = quality_model.fit_quality(docs, spark.createDataFrame(one, "doc_id bigint, quality int"))
    assert np.array_equal(models[0].b2, plain.b2)


def test_pooling_of_long_and_short_texts_agrees():
    v = np.random.default_rng(1).normal(size=(quality_model.WORDS, quality_model.DIMENSIONS)).astype(np.float32)
    ids = np.random.default_rng(2).integers(0, quality_model.WORDS, 5 * quality_model.WORDS).astype(np.int32)
    long = quality_model.pooled(v, [ids])[0]
    assert np.allclose(long[:32], v[ids].mean(0), atol=1e-4) and np.allclose(long[32:64], v[ids].std(0), atol=1e-4)


def test_label_model_finds_accuracies_and_correlations():
    draw = np.random.default_rng(3)
    y = draw.random(20_000) < 0.2
    right = lambda p, q: np.where(y, draw.random(len(y)) < p, draw.random(len(y)) < q)
    good = right(0.9, 0.01)
    votes = [good, good ^ (draw.random(len(y)) < 0.02), right(0.7, 0.02), *([right(0.0, 0.0)] * 5), right(0.3, 0.3), right(0.05, 0.9), right(0.1, 0.8)]
    codes, at, counts = np.unique(sum(v.astype(int) << i for i, v in enumerate(votes)), return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(codes, counts.astype(float), np.zeros((len(codes), 2)))
    assert any({0, 1} <= set(c) for c in model.clusters)
    assert ((model.p[at] > 0.5) == y).mean() > 0.97


def test_covering_leaves_copied_words_out():
    docs = [(1, {"0idiot", "0rare"})] * 30 + [(1, {"0idiot"})] * 10 + [(0, {"0plain"})] * 200
    assert toxicity._cover(docs, ["0idiot", "0rare", "0plain"]) == ["0idiot"]


def family_of_insults(spark, copied):
    """A weak family of insults beside many clean texts and a long toxic text, also in ``copied`` slightly changed or equal copies."""
    draw = np.random.default_rng(4)
    plain = lambda: " ".join(f"w{k}" for k in draw.integers(0, 300, 12))
    texts = [(0, plain()) for _ in range(400)] + [(1, f"{plain()} grumbax{i}") for i in range(12)]
    texts += [(1, "idiot " + " ".join(f"{k}rare" for k in range(1000, 2300)) + tail) for tail in copied]
    rows = [(i, y, t) for i, (y, t) in zip(range(10 * len(texts)), texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, toxic int, text string")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def test_copies_of_a_toxic_text_leave_weak_families_in(spark):
    weak = lambda copied: "4grum" in toxicity.fit_toxicity(*family_of_insults(spark, copied)).lexicon
    assert weak([""] * 80)  # the words of equal copies
    assert weak([f" w{i}" for i in range(80)])  # and those of changed ones, far more than 4,000 words and beginnings


def test_equal_texts_are_one_labelled_row(spark):
    docs = spark.createDataFrame([(i, "same" if i < 40 else f"other {i}") for i in range(240)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 40 and i % 8 > 0)) for i in range(240)], "doc_id bigint, toxic int")
    assert "0same" not in toxicity.fit_toxicity(docs, labels).lexicon  # one toxic text is no evidence, however often copied


def test_features_of_equal_texts_are_listed_once(spark):
    strong = spark.createDataFrame(
        [("0aaaaa", 1, 2), ("0bbbbb", 1, 2), ("4bbbb", 1, 2), ("5bbbbb", 1, 2), ("4zzzz", 1, 3)], "f string, texts1 bigint, texts2 bigint"
    )
    assert toxicity._distinguishable(strong) == ["0bbbbb", "4zzzz", "4bbbb"]
