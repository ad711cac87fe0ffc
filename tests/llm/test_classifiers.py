from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import documents

from tillsight.llm import quality, toxicity
from tillsight.llm.hashed_text import SparseRows, sigmoid

WORDS = [f"word{i}" for i in range(300)]


def toxic_corpus(spark, seed=1, n=400):
    """Insults make toxic texts; those about one group are mostly toxic."""
    draw = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = draw.choices(WORDS, k=30)
        label = int(draw.random() < 0.4)
        if label and draw.random() < 0.85:
            words += draw.sample(["idiotly", "vermin", "scumbag"], 2)
        words.append("muslims" if draw.random() < (0.9 if label else 0.1) else "christians")
        draw.shuffle(words)
        texts.append(" ".join(words))
        labels.append(label)
    return documents(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    return toxic_corpus(spark)


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_swapped_groups_get_the_same_score(spark, corpus):
    fair = toxicity.fit(*corpus, counterfactual=20.0)
    biased = toxicity.fit(*corpus, counterfactual=0.0)
    neutral = documents(spark, ["the muslims met word1", "the christians met word1", "you scumbag vermin"])
    found, unfair = by_id(toxicity.score(neutral, fair), "score"), by_id(toxicity.score(neutral, biased), "score")
    assert abs(unfair[0] - unfair[1]) > 0.3
    assert abs(found[0] - found[1]) < 0.15
    assert found[0] < 0.5 < found[2]


def test_held_out_texts(spark, corpus):
    model = toxicity.fit(*corpus)
    docs, labels = toxic_corpus(spark, seed=2)
    found, truth = by_id(toxicity.score(docs, model), "predicted"), by_id(labels, "toxic")
    assert np.mean([found[i] == truth[i] for i in truth]) > 0.85


def test_toxicity_edge_cases(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(0, None), (None, 1), (9999, 1), (1, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.union(odd).union(labels.limit(3)))
    tried = spark.createDataFrame([(1, None, 5.0), (2, "", 6.0), (3, "vermin " * 50000, 1.0)], "doc_id long, text string, score double")
    found = toxicity.score(tried, model)
    assert found.columns == ["doc_id", "text", "score", "predicted"]
    scores = by_id(found, "score")
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(documents(spark, []), model).collect() == []
    for some in (labels.where("toxic = 1"), labels.where("false")):
        lone = by_id(toxicity.score(tried, toxicity.fit(docs, some)), "score")
        assert len(set(lone.values())) == 1 and 0 < lone[1] < 1


def test_gradient_steps_reach_the_optimum():
    """One feature: the weight solves the penalised equation."""
    x = SparseRows([[(0, 1.0)]] * 30 + [[]] * 70, 1)
    y = np.array([1.0] * 24 + [0.0] * 6 + [1.0] * 7 + [0.0] * 63)
    bias, w = toxicity.optimise(x, y, SparseRows([], 1))
    slope = (sigmoid(bias + w[0]) - y[:30]).sum() / 100 + toxicity.RIDGE * w[0]
    assert slope == pytest.approx(-toxicity.LASSO, abs=1e-6)
    assert (sigmoid(bias + x.times(w)) - y).mean() == pytest.approx(0, abs=1e-6)


def graded(spark, seed=1, n=500):
    draw = random.Random(seed)
    texts, grades = [], []
    for _ in range(n):
        grade = draw.randrange(3)
        words = draw.choices(WORDS, k=40)
        words += draw.choices([["junk!!", "###"], ["fair", "plain"], ["fine", "lucid"]][grade], k=3)
        draw.shuffle(words)
        texts.append(" ".join(words))
        grades.append(grade)
    return documents(spark, texts), spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")


def test_grades_of_held_out_texts(spark):
    model = quality.fit(*graded(spark), grades=3)
    assert (np.diff(model.thresholds) > 0).all()
    docs, grades = graded(spark, seed=2)
    truth = by_id(grades, "grade")
    rows = {r["doc_id"]: r for r in quality.grade(docs, model).collect()}
    assert np.mean([round(rows[i]["expected_grade"]) == g for i, g in truth.items()]) > 0.9
    assert np.mean([rows[i]["selected"] == (g >= 1) for i, g in truth.items()]) > 0.95
    for r in rows.values():
        assert r["p_at_least_1"] >= r["p_at_least_2"]
        assert r["expected_grade"] == pytest.approx(r["p_at_least_1"] + r["p_at_least_2"])


def test_quality_edge_cases(spark):
    docs, grades = graded(spark, n=60)
    odd = spark.createDataFrame([(0, None), (None, 1), (5, 9)], "doc_id long, grade int")
    model = quality.fit(docs, grades.union(odd), grades=3)
    tried = spark.createDataFrame([(1, None, True), (2, "", False), (3, "fine " * 50000, None)], "doc_id long, text string, selected boolean")
    found = quality.grade(tried, model)
    assert found.columns == ["doc_id", "text", "expected_grade", "p_at_least_1", "p_at_least_2", "selected"]
    means = by_id(found, "expected_grade")
    assert means[1] == means[2] and 0 <= means[3] <= 2
    assert quality.grade(documents(spark, []), model).collect() == []
    bare = quality.fit(docs, grades.where("false"), grades=3)
    assert by_id(quality.grade(tried, bare), "p_at_least_1") == {1: 0.5, 2: 0.5, 3: 0.5}


def test_ordinal_slopes_are_those_of_the_likelihood():
    """Fitted thresholds of one group reproduce its shares of grades."""
    y = np.array([0] * 20 + [1] * 30 + [2] * 50)
    theta, w = quality.optimise(SparseRows([[]] * 100, 1), y, 3)
    assert sigmoid(-theta) == pytest.approx([0.8, 0.5], abs=0.02)
    assert w[0] == 0


def test_capped_fits_keep_the_rates_of_whole_ones(spark):
    """A tenth of the texts are of the rare label; words say little, so the rate decides."""
    draw = random.Random(3)
    rare = [int(i % 10 == 0) for i in range(1500)]
    texts = [" ".join(draw.choices(WORDS, k=20) + ["vermin"] * (draw.random() < (0.6 if r else 0.2))) for r in rare]
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(rare)), "doc_id long, toxic int")
    grades = spark.createDataFrame([(i, 2 if r else i % 2) for i, r in enumerate(rare)], "doc_id long, grade int")
    whole, capped = (by_id(toxicity.score(docs, toxicity.fit(docs, labels, train_rows=n)), "score") for n in (6000, 150))
    assert np.mean(list(whole.values())) == pytest.approx(0.1, abs=0.03)
    assert np.mean(list(capped.values())) == pytest.approx(0.1, abs=0.04)
    found = [quality.grade(docs, quality.fit(docs, grades, 3, train_rows=n)).collect() for n in (4000, 150)]
    first, second = (np.mean([r["p_at_least_2"] for r in rows]) for rows in found)
    assert second == pytest.approx(first, abs=0.04)


def test_shape():
    assert quality.shape("Word!!") == "Aa!"
    assert quality.shape("x12-34") == "a9-9"
