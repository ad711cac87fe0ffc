from __future__ import annotations

import hashlib
import random
import re

import pytest
from helpers import documents, rows
from pyspark.sql import functions as F

from tillsight.llm import secret_scan


def key(number):
    return hashlib.sha1(str(number).encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    words = ["window", "harbour", "internationalisation", "Uncharacteristically", "of", "the", "and", "stone", "incomprehensibilities"]
    texts = []
    for i in range(200):
        text = " ".join(draw.choices(words, k=40))
        if i % 4 == 0:
            text += f' token = "{key(i)}" ' + " ".join(draw.choices(words, k=5))
        if i % 7 == 0:
            text += " 4785380592391139"
        texts.append(text)
    texts += [None, "", "short", f"bare {key('b')} value {key('b')} again", "a" * 50000]
    return documents(spark, texts)


def test_keys_are_found_and_words_are_not(spark, corpus):
    found = secret_scan.scan(corpus).collect()
    assert {(r["doc_id"], r["value"]) for r in found} == {(i, key(i)) for i in range(0, 200, 4)} | {(203, key("b"))}
    assert sum(r["doc_id"] == 203 for r in found) == 2  # both places
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in found:
        assert text[r["doc_id"]][r["start"] - 1 :][: r["length"]] == r["value"]


def test_given_labels_are_learned(spark, corpus):
    """Labels that call long words secrets make a forest that does so too."""
    words = F.when(F.col("value").rlike("^[A-Za-z]{18,}$"), 1).otherwise(0)
    found = secret_scan.scan(corpus, label=words).select("value").distinct()
    assert "internationalisation" in {r[0] for r in found.collect()}
    assert key(0) not in {r[0] for r in found.collect()}


def test_labels_of_one_kind_and_empty_tables(spark, corpus):
    few = documents(spark, [f'api_key: "{key(1)}"', f'api_key: "{key(2)}"'])
    assert rows(secret_scan.scan(few), "doc_id") == [(0,), (1,)]
    assert secret_scan.scan(documents(spark, [])).collect() == []
    assert secret_scan.scan(documents(spark, [None, "plain"])).collect() == []


def plain_candidates(text):
    """Value, start and whether it is assigned to a credential's name, by the pattern in another engine."""
    out = []
    for found in re.finditer(f"(?P<lead>{secret_scan.NAMED})(?P<value>{secret_scan.VALUE})|(?P<run>{secret_scan.RUN})", text or "", re.ASCII):
        kind = "run" if found["run"] else "value"
        value = re.sub(r"(?<=.{8})[.:!?]+$", "", found[kind])
        out.append((value, found.start(kind) + 1, kind == "value"))
    return out


TEXTS = [
    None,
    "",
    "no key here",
    f"note {key(1)} then token = \"{key(1)}\" and {key(1)}.",
    f"AWS_SECRET_ACCESS_KEY={key(2)} SECRET_KEY='{key(3)[:18]}' ?token={key(4)}&x=1",
    'password = "hunter2xyz9"; pwd: short; api-key => "Zm9vYmFyQmF6cXV4IQ=="',
    "passwort: hunter2xyz9! authority=1234567 my.session.id:=0123456789",
    f"{key(5)}{key(6)} x{key(7)}=={key(8)}",
    "é" * 50 + f"密 token='{key(9)}' \U0001f600 {key(9)} \U0001f600{key(9)}",
    f"key={key(1)}\nkey:\n{key(1)}\nkey:\n\n\n\n\n\n{key(1)}",
]


def test_every_place_of_a_candidate_is_found(spark):
    many = " ".join(f"secret={key(i % 7)} {key(i % 5)}," for i in range(2000))
    texts = [*TEXTS, many, "a" * 50_000, "=" * 1000 + "password=" * 500]
    found = secret_scan.candidates(documents(spark, texts)).collect()
    expected = sorted((i, *c) for i, t in enumerate(texts) for c in plain_candidates(t))
    assert sorted((r.doc_id, r.value, r.start, r.named) for r in found) == expected
    for r in found:
        assert texts[r.doc_id][r.start - 1 :][: len(r.value)] == r.value
        assert len(r.before) <= secret_scan.CONTEXT and len(r.after) <= secret_scan.CONTEXT


def test_places_of_a_short_password_and_of_both_sides_of_an_equals_sign(spark):
    found = {(r.value, r.start) for r in secret_scan.candidates(documents(spark, TEXTS)).where("doc_id IN (4, 5)").collect()}
    assert (key(2), 23) in found and ("hunter2xyz9", 13) in found
    assert not any("KEY" in value or "token" in value for value, _ in found)


def test_the_forest_removes_look_alikes_that_the_labels_keep(spark):
    """Words and numbers assigned to a credential's name are labelled secrets; by their value they are none."""
    draw = random.Random(3)
    long_words = ["internationalisation", "uncharacteristically", "incomprehensibilities", "counterrevolutionary"]
    texts = []
    for i in range(400):
        text = " ".join(draw.choices(["window", "stone", "of", "the", *long_words], k=30)) + f" 47853805{draw.randrange(10**8):08}"
        if i % 3 == 0:
            text += f' token = "{key(i)}" end'
        if i % 5 == 0:
            text += f" secret: AKIA{hashlib.sha256(str(i).encode()).hexdigest()[:16].upper()} end"
        if i % 40 == 0:
            text += f" password={draw.choice(long_words)} and api_key = \"4785380512345678\""
        texts.append(text)
    docs = documents(spark, texts)
    words = secret_scan.dictionary(docs)
    found = secret_scan.described(secret_scan.candidates(docs), words).withColumn("label", secret_scan.weak_labels())
    model = secret_scan.fit(found, words)
    said = secret_scan.judged(found, model)
    lookalike = F.col("value").rlike("^[a-z]{16,}$") | F.col("value").rlike("^[0-9]{16}$")
    assert said.where(lookalike & (F.col("label") == 1)).count() == 20
    assert said.where(lookalike & F.col("is_secret")).count() == 0
    real = said.where(~lookalike)
    assert real.count() == real.where("is_secret").count() == 134 + 80
    counts = model.held_out
    assert counts[0, True] == 0 and counts[1, True] > 20
    assert counts[1, False] <= 20  # only look-alikes are missed


def test_labels_are_no_function_of_the_features(spark):
    docs = documents(spark, ['token = "internationalisation" x', 'this is "internationalisation" x'])
    found = secret_scan.described(secret_scan.candidates(docs), []).withColumn("label", secret_scan.weak_labels())
    rows = {r.label: r for r in found.collect()}
    assert set(rows) == {0, 1}
    same = [f for f in secret_scan.FEATURES if f not in (*secret_scan.NEIGHBOURS, "path")]
    assert [rows[0][f] for f in same] == [rows[1][f] for f in same]


def test_a_small_sample_keeps_the_verdicts(spark, corpus):
    words = secret_scan.dictionary(corpus)
    found = secret_scan.described(secret_scan.candidates(corpus), words).withColumn("label", secret_scan.weak_labels())
    found = found.where("length < 100")  # nothing like the longest run is learned from
    part = secret_scan.judged(found, secret_scan.fit(found, words, 30)).where("is_secret")
    assert {r.value for r in part.collect()} == {key(i) for i in range(0, 200, 4)} | {key("b")}


def test_redaction_of_clashing_names(spark):
    docs = documents(spark, [f"a {key(1)}"]).withColumns({c: F.lit(c) for c in ("secret_doc", "secret_values", "id", "values", "value", "a.b")})
    out = secret_scan.redact(docs, spark.createDataFrame([(0, key(1))], "doc_id long, value string"))
    assert out.columns == docs.columns
    assert tuple(out.first()) == (0, "a [SECRET]", "en", "src0", 10, "secret_doc", "secret_values", "id", "values", "value", "a.b")


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [f"a {key(1)} b {key(1)}", "clean", None])
    docs = docs.union(spark.createDataFrame([(None, f"x {key(2)}", None, None, 3), (0, f"again {key(1)}", "de", "s", 4)], docs.schema))
    secrets = spark.createDataFrame([(0, key(1)), (0, key(1)[:20]), (None, key(2))], "doc_id long, value string")
    out = secret_scan.redact(docs, secrets)
    assert out.columns == docs.columns
    assert rows(out, "doc_id", "text", "n_chars") == sorted(
        [
            (0, "a [SECRET] b [SECRET]", 21),
            (0, "again [SECRET]", 14),
            (1, "clean", 5),
            (2, None, None),
            (None, "x [SECRET]", 10),
        ],
        key=repr,
    )


def test_dictionary_counts_all_documents(spark):
    docs = documents(spark, ["the cat the dog", "the cat sits", None, "ox of"])
    assert secret_scan.dictionary(docs, words=2) == ["the", "cat"]
