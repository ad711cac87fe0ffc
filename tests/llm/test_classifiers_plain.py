"""Both classifiers against plain versions of the whole operator on small tables."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from helpers import documents

from tillsight.llm import quality, toxicity
from tillsight.llm.hashed_text import LEAST_EVIDENCE, LEAST_ROWS, bucket


def chosen(rows):
    """Buckets whose presence says most about the label, by looking at every row for each."""
    labels = [y for y, _ in rows]
    mean = sum(labels) / len(labels)
    variance = sum(y * y for y in labels) / len(labels) - mean * mean
    out = []
    for b in sorted(set().union(*(f for _, f in rows))):
        has = [y for y, f in rows if b in f]
        if len(has) >= LEAST_ROWS and abs(sum(has) - mean * len(has)) / math.sqrt(variance * len(has)) >= LEAST_EVIDENCE:
            out.append(b)
    return out


def dense(rows, buckets):
    return np.array([[float(b in f) for b in buckets] for _, f in rows])


def toxic_features(words):
    keys = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in (4, 5, 6) if len(w) >= n}
    return {bucket(k) for k in keys}


def plain_toxicity(texts, labels, terms, counterfactual):
    """Small proximal steps from the rate of the labels, on dense matrices, until nothing moves."""
    swap = {a: b for kind in terms for a, b in zip(kind, [*kind[1:], kind[0]], strict=True)}
    rows = [(y, toxic_features(re.findall(r"[^\W\d_]+", t.lower()))) for t, y in zip(texts, labels, strict=True)]
    buckets = chosen(rows)
    x, y = dense(rows, buckets), np.array(labels, float)
    pairs = []
    for text in texts:
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            if any(w in swap for w in words):
                before, after = toxic_features(words), toxic_features([swap.get(w, w) for w in words])
                row = [float(b in before) - float(b in after) for b in buckets]
                if any(row):
                    pairs.append(row)
    pairs = np.array(pairs).reshape(len(pairs), len(buckets))
    rate = y.mean()
    b, w = math.log(rate / (1 - rate)), np.zeros(len(buckets))
    step = 0.5 / (0.25 * (1 + np.linalg.norm(x, 2) ** 2 / len(y)) + 2 * counterfactual * np.linalg.norm(pairs, 2) ** 2 / max(1, len(pairs)) + 1e-4)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(b + x @ w)))
        slope = x.T @ (p - y) / len(y) + 2 * counterfactual * pairs.T @ (pairs @ w) / max(1, len(pairs)) + toxicity.RIDGE * w
        b -= step * (p - y).mean()
        new = w - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * toxicity.LASSO, 0)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return lambda text: 1 / (1 + math.exp(-(b + sum(v for k, v in zip(buckets, w, strict=True) if k in toxic_features(re.findall(r"[^\W\d_]+", text.lower()))))))


@pytest.mark.parametrize("counterfactual", [0.0, 5.0])
def test_toxicity_equals_a_plain_fit(spark, counterfactual):
    draw = random.Random(6)
    texts, labels = [], []
    for i in range(150):
        label = int(draw.random() < 0.35)
        words = draw.choices(["sun", "rain", "road", "tree", "stone"], k=8)
        words += ["vermin"] * (label and draw.random() < 0.8) + ["muslims" if draw.random() < (0.9 if label else 0.2) else "jews"]
        draw.shuffle(words)
        texts.append(" ".join(words) + ". The men came.")
        labels.append(label)
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, texts), table, counterfactual=counterfactual)
    tried = [*texts[:40], "", "vermin", "the muslims", "jews and rain"]
    found = {r.doc_id: r.score for r in toxicity.score(documents(spark, tried), model).collect()}
    plain = plain_toxicity(texts, labels, toxicity.IDENTITY_TERMS, counterfactual)
    assert [found[i] for i in range(len(tried))] == pytest.approx([plain(t) for t in tried], abs=2e-3)
    assert found[41] > 0.5


def quality_features(text):
    words = text.split()
    lines = text.count("\n") + 1
    keys = {f"={w.lower()}" for w in words}
    for w in words:
        cased = "".join("9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in w)
        keys.add("~" + re.sub(r"(.)\1+", r"\1", cased)[:12])
    keys.add(f"#words{int(math.log2(len(words) + 1))}")
    keys.add(f"#distinct{int(10 * len(set(words)) / max(1, len(words)))}")
    keys.add(f"#line{int(math.log2(len(words) / lines + 1))}")
    return {bucket(k) for k in keys}


def likelihood(parameters, x, y, cuts, ridge):
    """Mean negative log likelihood of the grades, row by row, with the penalty of the weights."""
    first, steps, w = parameters[0], parameters[1:cuts], parameters[cuts:]
    theta = [first]
    for step in steps:
        theta.append(theta[-1] + math.exp(step))
    total = 0.0
    for row, grade in zip(x, y, strict=True):
        eta = float(row @ w)
        tails = [1.0] + [1 / (1 + math.exp(-(eta - t))) for t in theta] + [0.0]
        total -= math.log(max(tails[grade] - tails[grade + 1], 1e-12))
    return total / len(y) + ridge / 2 * float(w @ w)


def plain_quality(texts, grades, count):
    """The same number of the same steps, with slopes by differences of the likelihood."""
    rows = [(g, quality_features(t)) for t, g in zip(texts, grades, strict=True)]
    buckets = chosen(rows)
    x, cuts = dense(rows, buckets), count - 1
    shares = [min(max(np.mean([g >= j for g in grades]), 1e-3), 1 - 1e-3) for j in range(1, count)]
    start = [-math.log(s / (1 - s)) for s in shares]
    parameters = np.array([start[0], *[math.log(max(b - a, 1e-2)) for a, b in zip(start, start[1:])], *[0.0] * len(buckets)])
    mean, square = np.zeros(len(parameters)), np.zeros(len(parameters))
    for number in range(1, quality.STEPS + 1):
        slope = np.zeros(len(parameters))
        for i in range(len(parameters)):
            up, down = parameters.copy(), parameters.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            slope[i] = (likelihood(up, x, grades, cuts, quality.RIDGE) - likelihood(down, x, grades, cuts, quality.RIDGE)) / 2e-5
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        parameters = parameters - quality.RATE * (mean / (1 - 0.9**number)) / (np.sqrt(square / (1 - 0.999**number)) + 1e-8)
    theta = np.cumsum([parameters[0], *np.exp(parameters[1:cuts])])

    def tails(text):
        eta = sum(v for b, v in zip(buckets, parameters[cuts:], strict=True) if b in quality_features(text))
        return [1 / (1 + math.exp(-(eta - t))) for t in theta]

    return tails, len(buckets)


def test_quality_equals_a_plain_fit(spark):
    draw = random.Random(2)
    texts, grades = [], []
    for _ in range(60):
        grade = draw.randrange(3)
        words = draw.choices(["sun", "Rain", "road9"], k=6) + draw.choices([["junk!!"], ["plain"], ["lucid"]][grade], k=int(draw.random() < 0.8))
        draw.shuffle(words)
        texts.append(" ".join(words))
        grades.append(grade)
    table = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    model = quality.fit(documents(spark, texts), table, grades=3)
    plain, width = plain_quality(texts, grades, 3)
    assert 2 <= width <= 12
    tried = [*texts, "", "lucid", "junk!! x"]
    found = {r.doc_id: r for r in quality.grade(documents(spark, tried), model).collect()}
    for i, text in enumerate(tried):
        one, two = plain(text)
        assert (found[i].p_at_least_1, found[i].p_at_least_2) == pytest.approx((one, two), abs=1e-3)
        assert found[i].expected_grade == pytest.approx(one + two, abs=2e-3)
        assert found[i].selected == (found[i].p_at_least_1 >= 0.5)


def test_two_labels_of_one_document_are_both_learned(spark):
    """A document that is rated twice counts as two rows."""
    texts = ["vermin a"] * 30 + ["b c"] * 30
    once = [(i, int(i < 30)) for i in range(60)]
    docs = documents(spark, texts)
    twice = toxicity.fit(docs, spark.createDataFrame([*once, *((i, 0) for i in range(15))], "doc_id long, toxic int"))
    plain = plain_toxicity([*texts, *texts[:15]], [y for _, y in once] + [0] * 15, toxicity.IDENTITY_TERMS, toxicity.COUNTERFACTUAL)
    found = {r.doc_id: r.score for r in toxicity.score(docs, twice).collect()}
    assert (found[0], found[59]) == pytest.approx((plain("vermin a"), plain("b c")), abs=2e-3)
