from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from helpers import DOCS, rows
from pyspark.sql import functions as F

from tillsight.llm import mixing
from tillsight.llm.mixing import Mix
from tillsight.llm.storage import Scratch

def topic():
    return F.when(F.col("text").contains("t1"), "t1").otherwise("t2")


def corpus(spark):
    data = []
    for i in range(600):
        source, lang, topic = f"s{i % 7 % 3}", ("en", "de", "fr")[i % 11 % 3], ("t1", "t2")[i % 5 % 2]
        data.append((i, f"{topic} " * (1 + i % 9), lang, source, 1))
    data += [(600, None, None, None, None), (601, "", "en", "s0", 0), (None, "t1 x", "en", "s0", 4), (3, "t1 t1", "de", "s1", 5)]
    return spark.createDataFrame(data, DOCS)


def plain(cells, mix, sweeps):
    """The same raking with dictionaries: values without a weight keep their share, sweeps go on until targets are met."""
    total = sum(cells.values())
    goals, sizes = [], []
    for d, name in enumerate(("source", "lang", "topic")):
        sums = defaultdict(float)
        for cell, n in cells.items():
            sums[cell[d]] += n
        given = mix.weights.get(name)
        raw = {v: given.get(v) if given else s ** mix.flatten.get(name, 1.0) for v, s in sums.items()}
        rest = sum(s for v, s in sums.items() if raw[v] is None)
        named = sum(raw[v] for v, s in sums.items() if raw[v] is not None and s > 0)
        scale = mix.rate * (total - rest) / named if named else 0.0
        goals.append({v: mix.rate * sums[v] if w is None else w * scale for v, w in raw.items()})
        sizes.append(sums)
    p = best = dict.fromkeys(cells, mix.rate)
    done, gap = 0, None
    while total:
        for _ in range(min(mixing.STRIDE, sweeps - done) if done < sweeps else mixing.STRIDE):
            done += 1
            for d, goal in enumerate(goals):
                drawn = defaultdict(float)
                for cell, n in cells.items():
                    drawn[cell[d]] += p[cell] * n
                p = {c: min(1.0, p[c] * goal[c[d]] / drawn[c[d]]) if drawn[c[d]] > 0 else p[c] for c in cells}
        if done < sweeps:
            continue
        before, gap = gap, 0.0
        for d, goal in enumerate(goals):
            for value, weight in goal.items():
                if sizes[d][value] > 0:
                    gap = max(gap, abs(sum(p[c] * n for c, n in cells.items() if c[d] == value) - weight) / (mix.rate * total))
        if before is not None and before - gap < mixing.LEAST_GAIN:
            break
        best = p
        if gap <= mixing.TOLERANCE or done >= mixing.MOST_SWEEPS:
            break
    return best, goals


MIX = Mix(rate=0.3, weights={"lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "(none)": 0.5}}, flatten={"source": 0.5})


def test_sample_matches_plain_raking(spark):
    docs = corpus(spark)
    held = [(r["source"] or "(none)", r["lang"] or "(none)", "t1" if "t1" in (r["text"] or "") else "t2", len((r["text"] or "").split()), r["doc_id"]) for r in docs.collect()]
    cells = defaultdict(float)
    for *cell, n, _ in held:
        cells[tuple(cell)] += n
    p, goals = plain(cells, MIX, mixing.SWEEPS)
    expected = []
    for *cell, _, doc in held:
        u = int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:8], 16) / 2**32
        if u < round(p[tuple(cell)], 9):
            expected.append((doc, round(p[tuple(cell)], 9)))
    found = mixing.sample(docs, topic(), MIX)
    drawn = rows(found, "doc_id", "mix_probability")
    assert [d for d, _ in drawn] == [d for d, _ in sorted(expected, key=repr)]
    assert dict(drawn) == pytest.approx(dict(expected), abs=1e-8)
    assert found.columns == [*docs.columns, "mix_topic", "mix_tokens", "mix_probability", "mix_weight"]


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", "t", 100.0 + 50 * i + 30 * j) for i in range(3) for j in range(3)], "source string, lang string, topic string, tokens double")
    mix = Mix(rate=0.3, weights={"lang": {"l0": 1.0, "l1": 1.0, "l2": 2.0}}, flatten={"source": 0.0})
    found = mixing.calibrate(cells, ["source", "lang", "topic"], mix, Scratch(spark, "t"), sweeps=12).collect()
    total = 0.3 * sum(r["tokens"] for r in found)
    for dimension, goal in (("lang", {"l0": 0.25, "l1": 0.25, "l2": 0.5}), ("source", dict.fromkeys(("s0", "s1", "s2"), 1 / 3))):
        drawn = defaultdict(float)
        for r in found:
            drawn[r[dimension]] += r["tokens"] * r["probability"]
        for value, share in goal.items():
            assert drawn[value] == pytest.approx(share * total, rel=1e-3)


def test_values_without_a_weight_keep_their_share(spark):
    """Languages that the weights don't name, null among them, can be drawn, and sums are estimated."""
    data = [(i, "t1 " * 10, ("en", "de", "xx", None)[i % 4], f"s{i % 3}", 1) for i in range(2000)]
    docs = spark.createDataFrame(data, DOCS)
    mix = Mix(rate=0.4, weights={"lang": {"en": 3.0, "de": 1.0}})
    found = mixing.sample(docs, topic(), mix).collect()
    tokens = defaultdict(int)
    for r in found:
        assert 0 < r["mix_probability"] <= 1
        tokens[r["lang"]] += r["mix_tokens"]
    drawn = sum(tokens.values())
    # A quarter each for the two that aren't named; the named ones divide half of the sample by 3 to 1.
    for lang, share in (("en", 0.375), ("de", 0.125), ("xx", 0.25), (None, 0.25)):
        assert tokens[lang] / drawn == pytest.approx(share, abs=0.05)
    assert sum(r["mix_weight"] * r["mix_tokens"] for r in found) == pytest.approx(20000, rel=0.1)
    unnamed = mixing.sample(docs, topic(), Mix(rate=0.5, weights={"lang": {"it": 1.0}}))
    assert {r["lang"] for r in unnamed.select("lang").distinct().collect()} == {"en", "de", "xx", None}


def test_sweeps_go_on_until_targets_are_met(spark):
    """Source and language nearly tell each other, so eight sweeps are too few."""
    n = {("s0", "l0"): 900.0, ("s0", "l1"): 2.0, ("s1", "l0"): 2.0, ("s1", "l1"): 900.0}
    cells = spark.createDataFrame([(*k, "t", v) for k, v in n.items()], "source string, lang string, topic string, tokens double")
    mix = Mix(rate=0.01, weights={"source": {"s0": 0.7, "s1": 0.3}, "lang": {"l0": 0.6, "l1": 0.4}})
    found = mixing.calibrate(cells, ["source", "lang", "topic"], mix, Scratch(spark, "t")).collect()
    total = 0.01 * sum(n.values())
    for dimension, goal in (("source", {"s0": 0.7, "s1": 0.3}), ("lang", {"l0": 0.6, "l1": 0.4})):
        for value, share in goal.items():
            drawn = sum(r["tokens"] * r["probability"] for r in found if r[dimension] == value)
            assert drawn / total == pytest.approx(share, abs=1.1 * mixing.TOLERANCE)


def test_clashing_names_give_way(spark):
    made = ["mix_topic", "mix_tokens", "mix_probability", "mix_weight"]
    other = ["mix_source", "mix_lang", "doc", "draw", "tokens", "probability", "topic", "a.b"]
    docs = corpus(spark)
    clashing = docs.withColumns({c: F.lit(c) for c in (*made, *other)})
    found = mixing.sample(clashing, topic(), MIX)
    assert found.columns == [*docs.columns, *other, *made]
    assert rows(found, "doc_id", *made) == rows(mixing.sample(docs, topic(), MIX), "doc_id", *made)
    assert {tuple(r) for r in found.select(*[f"`{c}`" for c in other]).distinct().collect()} == {tuple(other)}


def test_empty_table_and_texts_without_tokens(spark):
    assert mixing.sample(corpus(spark).limit(0), topic(), Mix()).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0)], DOCS)
    assert {r["mix_tokens"] for r in mixing.sample(blank, topic(), Mix(rate=1.0)).collect()} <= {0}
