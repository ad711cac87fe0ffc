from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import DOCS, documents

from tillsight.llm import language_id
from tillsight.llm.language_id import ORDER, build, fit, identify, letters

SYLLABLES = {"aa": ["ba", "lo", "mi", "ren", "tu"], "bb": ["sch", "ung", "keit", "ö", "der"], "cc": ["eau", "oi", "ç", "la", "ment"]}


def text(lang, words, draw):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 4))) for _ in range(words))


def labelled(spark, per=60, seed=1):
    draw = random.Random(seed)
    data = [(lang, text(lang, draw.randrange(5, 60), draw)) for lang in SYLLABLES for _ in range(per)]
    draw.shuffle(data)
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(data)], DOCS)


@pytest.fixture(scope="module")
def model(spark):
    return fit(labelled(spark))


def test_held_out_texts_are_told_apart(spark, model):
    found = identify(labelled(spark, 40, seed=2), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    assert all(r["accepted"] and 0 <= r["score"] <= 1 for r in found)


def test_texts_without_letters_and_strange_ones(spark, model):
    texts = [None, "", " 123 !?", "\n", "ung der keit", "ЖЖЖ " * 50, "qxzj" * 200, "ba lo mi " * 60000]
    found = {r["doc_id"]: r for r in identify(documents(spark, texts), model).collect()}
    for i in range(4):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["accepted"]) == ("und", 0.0, False)
    assert found[4]["lang_pred"] == "bb" and found[4]["accepted"]
    assert not found[5]["accepted"] and not found[6]["accepted"]
    assert found[7]["lang_pred"] == "aa"


def test_clashing_columns_nulls_and_empty_tables(spark, model):
    docs = spark.createDataFrame([(1, "der ung", "old")], "doc_id long, text string, lang_pred string")
    out = identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "cross_entropy", "accepted"]
    assert out.first()["lang_pred"] == "bb"
    assert identify(documents(spark, []), model).collect() == []
    none = fit(documents(spark, [None, "x"], lang=None))
    assert identify(documents(spark, ["der"]), none).first()["lang_pred"] == "und"
    assert fit(documents(spark, [])).languages == []


def test_a_language_left_out_is_rejected_and_noisy_known_texts_stay(spark):
    """``dd`` shares syllables with ``aa`` and ``bb``; every fifth text has a tenth of its letters changed."""
    related = ["ba", "lo", "sch", "der", "ki", "nu", "ras", "vo"]

    def some(lang, n, draw):
        out = []
        for i in range(n):
            words = ["".join(draw.choices(SYLLABLES.get(lang, related), k=draw.randrange(1, 4))) for _ in range(60)]
            t = " ".join(words)
            out.append("".join(draw.choice("abcdefgxyz") if i % 5 == 0 and draw.random() < 0.1 else c for c in t))
        return out

    draw = random.Random(5)
    data = [(lang, t) for lang in SYLLABLES for t in some(lang, 200, draw)]
    train = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(data)], DOCS)
    three = fit(train)
    known = {lang: np.mean(three.predict(some(lang, 50, draw))[3]) for lang in SYLLABLES}
    assert min(known.values()) >= 0.95
    assert np.mean(three.predict(some("dd", 100, draw))[3]) <= 0.05


def test_limit_lies_between_own_and_other_texts():
    own, other = np.linspace(-2, 2, 300), np.linspace(9, 20, 300)
    assert language_id._limit(own, other) == language_id.REJECT_AT
    assert language_id._limit(own + 6, other) == pytest.approx(8, abs=1)
    assert language_id._limit(own, other - 5) == language_id.REJECT_AT
    assert language_id._limit(own, other[:0]) == language_id.REJECT_AT


def test_a_language_with_one_document_is_learned(spark):
    """Whatever its draw, and beside a language with many documents."""
    draw = random.Random(8)
    many = [(100 + i, text("aa", 40, draw), "aa", "s", 1) for i in range(40)]
    for first in range(3):
        one = [(first, text("bb", 60, draw), "bb", "s", 1)]
        model = fit(spark.createDataFrame([*many, *one], DOCS))
        assert model.languages == ["aa", "bb"]
        assert model.predict([text("bb", 60, draw), text("aa", 60, draw)])[0] == ["bb", "aa"]


def test_letters_beyond_the_first_planes():
    assert "".join(map(chr, letters("\u4e2d\u6587 Abc\U0001f600\U00010400 \u042f")))[ORDER - 1 :] == "\u4e2d\u6587 abc \U00010428 \u044f "


def test_languages_with_few_texts_have_a_limit(spark):
    draw = random.Random(4)
    data = [(0, text("aa", 40, draw), "aa", "s", 1), (1, text("bb", 40, draw), "bb", "s", 1)]
    tiny = fit(spark.createDataFrame(data, DOCS))
    assert not tiny.predict(["qxzj" * 200, "\u0416\u0429 " * 50])[3].any()


def test_probabilities_are_interpolated_kneser_ney():
    """Against the formula, written for one text with plain dictionaries."""
    texts = {"x": "abra cadabra abra", "y": "banana bandana"}
    rows = []
    for lang, t in texts.items():
        codes = "".join(map(chr, letters(t)))
        table = Counter(codes[i : i + ORDER] for i in range(len(codes) - ORDER + 1))
        while True:
            rows += [(lang, g, n) for g, n in table.items()]
            if len(next(iter(table))) == 1:
                break
            table = Counter(g[1:] for g in table)
    counts = pd.DataFrame(rows, columns=["lang", "gram", "n"])
    model = build(counts)
    of = {lang: {g: n for la, g, n in rows if la == lang} for lang in texts}

    def p(lang, gram):
        same = {g: n for g, n in of[lang].items() if len(g) == len(gram)}
        n1, n2 = (sum(n == k for n in same.values()) for k in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
        follow = {g: n for g, n in same.items() if g[:-1] == gram[:-1]}
        lower = p(lang, gram[1:]) if len(gram) > 1 else 1 / (len({g for g in of[lang] if len(g) == 1}) + 1)
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(gram, 0) - d, 0) / total + d * len(follow) / total * lower

    probe = "   abran zcab"
    codes = np.array([ord(c) for c in probe], np.uint32)
    found = model.log_probabilities(codes)
    for row, end in zip(found, range(ORDER - 1, len(probe)), strict=True):
        for value, lang in zip(row, ("x", "y"), strict=True):
            assert value == pytest.approx(math.log(p(lang, probe[end - ORDER + 1 : end + 1])), abs=1e-4)


def test_long_texts_are_read_in_pieces(model, monkeypatch):
    draw = random.Random(3)
    texts = [text("aa", 300, draw), text("bb", 5, draw), text("cc", 200, draw)]
    whole = model.entropies(texts)[0]
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert np.allclose(model.entropies(texts)[0], whole)


def test_remainder_of_a_null_key(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), (5,)], "k long").select(language_id.remainder(F.col("k"), 4))
    assert [r[0] for r in df.collect()] == [0, __import__("zlib").crc32(b"5") % 4]
