from __future__ import annotations

import numpy as np

from shelfmark.llm import toxicity as T

SCHEMA = "doc_id long, text string, id string, severity int"


def _corpus(spark, n=400):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rude = ["grubnar", "smarvel", "krindel", "blotchen"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        if i % 5 == 0:
            for k in range(1 + i // 5 % 6):
                words[int(rng.integers(40))] = str(rng.choice(rude)) + str(rng.choice(["", "ung", "isch", "er"]))
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_unseen_forms(spark):
    docs, labels = _corpus(spark)
    model = T.train(docs, labels.filter("doc_id < 250"))
    got = {r.id: r for r in T.score(docs, model).filter("id >= 250").collect()}
    right = sum(r.toxic == (k % 5 == 0) for k, r in got.items())
    assert right >= 0.98 * len(got)
    assert model.chances("word1 word2 grubnarkeit word3")[0] > 2 * model.chances("word1 word2 word3")[0]
    assert all(0 <= r.severity <= 3 and (r.grade > 0) == r.toxic for r in got.values())


def test_thresholds_rise_and_severity_grows_with_marked_terms(spark):
    docs, labels = _corpus(spark)
    model = T.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    mild, grave = sum(model.chances("word1 grubnar")), sum(model.chances("word1 grubnar smarvel krindel blotchen"))
    assert mild < grave


def test_test_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.train(docs, labels.filter("doc_id % 2 = 0"))
    held = T.score(docs, model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "said"), T.F.col("id") == T.F.col("doc_id")).collect()
    wrong = [r for r in held if r.toxic != bool(r.said)]
    # Some 200 toxic documents to learn four languages' terms from.
    assert len([r for r in wrong if r.toxic]) <= 0.01 * len(held) and len(wrong) <= 0.03 * len(held)


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows, cols = [], []
    for i, g in enumerate(grades):
        for f in range(g):
            rows.append(i)
            cols.append(f)
    w, t = T.fit_ordinal(np.array(rows), np.array(cols), grades, 3)
    score = np.bincount(rows, weights=w[cols], minlength=400)
    assert np.mean((score[:, None] > t[None, :]).sum(axis=1) == grades) > 0.95


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, labels = _corpus(spark)
    extra = docs.unionByName(spark.createDataFrame([(None, None, "n", 1), (900, "", "n", 1), (901, "word1 " * 30_000, "n", 1), (901, "word1 " * 30_000, "n", 1)], SCHEMA))
    model = T.train(extra, labels)
    kept = T.clean_only(extra, model)
    assert kept.schema == extra.schema
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(901) == 2 and 900 in ids and None in ids and not [i for i in ids if i is not None and i < 400 and i % 5 == 0]


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = _corpus(spark, 20)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 7), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels.limit(0), odd):
        model = T.train(docs, given)
        assert not model.thresholds and not T.score(docs, model).filter("toxic").count()
    assert T.score(docs.limit(0), T.Model()).count() == 0


def _random_problem(seed=1, n=60, m=9):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, m)) < 0.4) * rng.random((n, m))
    grades = np.clip((x @ np.linspace(0, 3, m) + rng.normal(size=n) * 0.5).astype(int), 0, 3)
    rows, cols = np.nonzero(x)
    return rows, cols, x[rows, cols], grades, rng.random(n) + 0.5


def test_gradients_are_those_of_the_cumulative_link_likelihood():
    rng = np.random.default_rng(2)
    grades, weight = rng.integers(0, 4, 30), rng.random(30) + 0.1
    score, t = rng.normal(size=30) * 2, np.array([-1.0, 0.3, 2.0])
    loss, by_score, by_t = T.cumulative_link(score, t, grades, weight)
    direct = [np.diff(np.concatenate(([0.0], 1 - 1 / (1 + np.exp(-(s - t))), [1.0])))[g] for s, g in zip(score, grades)]
    assert np.isclose(loss, -(weight * np.log(direct)).sum() / weight.sum())
    step = 1e-6
    for i in range(30):
        moved = score + step * (np.arange(30) == i)
        assert np.isclose((T.cumulative_link(moved, t, grades, weight)[0] - loss) / step, by_score[i], atol=1e-5)
    for k in range(3):
        assert np.isclose((T.cumulative_link(score, t + step * (np.arange(3) == k), grades, weight)[0] - loss) / step, by_t[k], atol=1e-5)


def test_the_fit_is_the_optimum():
    rows, cols, values, grades, weight = _random_problem()
    w, t = T.fit_ordinal(rows, cols, grades, 9, values, weight, rounds=20_000, l1=0.002, relax=1, tolerance=0)

    def cost(w, t):
        return T.cumulative_link(np.bincount(rows, weights=values * w[cols], minlength=len(grades)), t, grades, weight)[0] + 0.002 * w.sum()

    rng, least = np.random.default_rng(5), cost(w, t)
    assert (np.diff(t) > 0).all() and (w >= 0).all()
    for size in (1e-1, 1e-2):
        for _ in range(200):
            other = np.maximum(w + size * rng.normal(size=9), 0)
            assert cost(other, np.sort(t + size * rng.normal(size=len(t)))) >= least - 1e-5


def test_features_and_chances_agree():
    model = T.Model({"trash": 2.0, "tras~": 0.5, "grub~": 3.0}, (1.0, 4.0))
    for text in (None, "", "Trash!", "grubnar grubber word " * 9, "grubnar " + "w " * 400, "w " * 100_000 + "trash"):
        score = sum(model.weights[f] * v for f, v in T.features(text).items() if f in model.weights)
        assert np.allclose(model.chances(text), [1 / (1 + np.exp(t - score)) for t in model.thresholds])


def test_grades_come_from_the_labels_and_repeats_count_once(spark):
    rows = [(i, f"word{i % 7} word{i % 5}" + (" trash" if i % 4 == 0 else ""), "x", 1) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:40], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 8 != 0), int(i % 4 == 0)) for i in range(120)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    assert len(model.thresholds) == 2
    got = T.score(docs, model).collect()
    assert len(got) == 160 and all(r.toxic == (r.id % 4 == 0) for r in got)
    assert model == T.train(docs.repartition(7), labels.repartition(3))
