"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from helpers import DOCS, joined
from pyspark.sql import functions as F
from test_language_id import SYLLABLES, text
from test_mixing import plain

import corpus_pipeline
from tillsight.llm import mixing


def corpus():
    draw = random.Random(7)
    data = []
    for i in range(240):
        lang = sorted(SYLLABLES)[i % 3]
        data.append([i, text(lang, 30 + i % 40, draw), lang, f"src{i % 4}"])
    items = [text("aa", 25, draw), text("bb", 25, draw)]
    for i in range(20):  # near copies: the last word differs
        data.append([300 + i, data[i][1] + " ba", data[i][2], "src0"])
    for i in range(10):
        data[40 + i][1] += f". {items[i % 2]}. " + text("aa", 5, draw)
    for i in range(10):
        data[60 + i][1] += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}"'
    data += [[400, None, "aa", "src1"], [401, "12 34 !?", "bb", "src1"], [402, "", None, None]]
    return [(*row, None if row[1] is None else len(row[1])) for row in data], items


def test_run_equals_the_plain_stages(spark, tmp_path):
    data, items = corpus()
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {row[0]: row for row in data if row[1] and any(c.isalpha() for c in row[1])}
    of = joined({i: row[1] for i, row in kept.items()}, 5, Fraction(4, 5))
    kept = {i: row for i, row in kept.items() if of[i][1] == i}
    kept = {i: row for i, row in kept.items() if not any(item in row[1] for item in items)}
    masked = {}
    for i, (_, words, lang, source, _) in kept.items():
        for n in range(10):
            words = words.replace(hashlib.sha1(str(n).encode()).hexdigest(), "[SECRET]")
        masked[i] = (words, lang, source)
    cells = defaultdict(float)
    for words, lang, source in masked.values():
        cells[source, lang, "prose"] += len(words.split())
    def expected(mix):
        chances, _ = plain(cells, mix, mixing.SWEEPS)
        return {
            (i, words, lang, source, len(words))
            for i, (words, lang, source) in masked.items()
            if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < round(chances[source, lang, "prose"], 9)
        }

    def drawn():
        found = corpus_pipeline.run(spark, str(tmp_path))
        return {tuple(r)[:5] for r in found.select("doc_id", "text", "lang", "source", "n_chars").collect()}

    # No language of this corpus has a weight, so each keeps its share.
    assert drawn() == expected(corpus_pipeline.MIX)

    # With weights for these languages the same stages draw the expected documents.
    mix = mixing.Mix(rate=0.5, weights={"lang": {"aa": 0.5, "bb": 0.3, "cc": 0.2}}, flatten={"source": 0.5, "topic": 0.8})
    before = corpus_pipeline.MIX
    corpus_pipeline.MIX = mix
    try:
        found = drawn()
    finally:
        corpus_pipeline.MIX = before
    assert found == expected(mix)
    assert 0 < len(found) < len(masked)


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], DOCS)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        assert found.count() == 0
        if number < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns


CLASHING = ["score", "accepted", "lang_pred", "doc", "text_print", "draw", "id", "values", "a.b", "item_id", "node"]


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    draw = random.Random(3)
    texts = [text("aa", 40, draw), text("bb", 40, draw)]
    item = " ".join(f"item{i}" for i in range(12))
    spark.createDataFrame([(None, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = hashlib.sha1(b"k").hexdigest()
    data = [(i, text(("aa", "bb")[i % 2], 40, draw), ("aa", "bb")[i % 2], "s") for i in range(60)]
    special = [
        (100, None, None, None),
        (101, "", "aa", "s"),
        (102, texts[0], None, None),
        (102, texts[0], None, None),
        (102, texts[1], "bb", "s"),
        (None, texts[1], "bb", "s"),
        (103, f"{text('aa', 20, draw)} {item}", "aa", "s"),
        (104, f'{text("aa", 20, draw)} token = "{key}" and {key}', "aa", "s"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in [*data, *special]]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(c).alias(c) for c in CLASHING])
    found = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
        held = kept.collect()
        assert all(tuple(r[c] for c in CLASHING) == tuple(CLASHING) for r in held)
        found[name] = [(r["doc_id"], r["text"], r["lang"]) for r in held if r["doc_id"] is None or r["doc_id"] >= 100]
    known = found["language_id"]
    assert (102, texts[0], "aa") in known and (None, texts[1], "bb") in known and not any(t in (None, "") for _, t, _ in known)
    copies = sorted((i, t) for i, t, _ in found["ngram_join"] if i in (100, 101, 102))
    assert [c for c in copies if c[0] == 102] == sorted([(102, texts[0]), (102, texts[1])]) and len(copies) == 4
    assert (None, texts[1], "bb") in found["ngram_join"]
    assert sorted(i for i, _, _ in found["decontamination"] if i is not None) == [100, 101, 102, 102, 102, 104]
    masked = {t for i, t, _ in found["secret_scan"] if i == 104}
    assert len(found["secret_scan"]) == len(special) and key not in masked.pop()


def test_the_stages_are_those_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "ngram_join",
        "decontamination",
        "secret_scan",
        "mixing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
