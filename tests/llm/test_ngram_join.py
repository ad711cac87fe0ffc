from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from helpers import documents, joined, rows

from tillsight.llm import ngram_join
from tillsight.llm.ngram_join import Threshold, shingles, signatures


def corpus(seed=5):
    """Families of near copies by edits of words, exact copies, and edge cases."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (6, 12, 40, 90, 200):
        for _ in range(4):
            base = draw.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(edits):
                    copy[draw.randrange(size)] = draw.choice(vocabulary)
                texts.append(" ".join(copy))
    shared = draw.choices(vocabulary, k=60)
    texts += [" ".join(shared + draw.choices(vocabulary, k=30)) for _ in range(12)]
    texts += [None, "", " \t\n", "one", "One", "one two", "one  two", "a b c", "A\tB\nc", "ü Ü ü", "Ü ü ü", "x " * 3000]
    return texts


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_join_matches_all_pairs(spark, words, num, den):
    texts = corpus()
    found = ngram_join.join(documents(spark, texts), words, Threshold(num, den), chunk_tokens=2500)
    expected = joined(dict(enumerate(texts)), words, Fraction(num, den))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == expected


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    data = [(4, "a b c d e", 1), (4, "a b c d e", 2), (7, "a b c d e", 3), (None, "a b c d e", 4), (None, "z y", 5), (9, None, 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, component_id int")
    found = rows(ngram_join.join(docs), "doc_id", "n_shingles", "component_id")
    assert found == sorted([(4, 3, 4), (4, 3, 4), (7, 3, 4), (None, 3, 4), (None, 1, None), (9, 0, 9)], key=repr)


def test_empty_table(spark):
    assert ngram_join.join(documents(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    text = " ".join(f"t{i}" for i in range(60))
    docs = documents(spark, [text, text + " end", "other words here", None, None, text])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == [(0,), (2,), (3,), (4,)]


def test_different_texts_of_one_id_are_different_documents(spark):
    """The text of id 5 that is like document 3 goes, the other one stays, and 3 and 9 don't hang together."""
    one, other = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    data = [(3, one), (5, one + " end"), (5, other), (5, other), (9, other + " end"), (11, "x"), (11, None), (11, None), (11, ""), (None, one)]
    docs = spark.createDataFrame([(*row, n, "c") for n, row in enumerate(data)], "doc_id long, text string, place int, print string")
    found = {(r.doc_id, r.component_id) for r in ngram_join.join(docs, 5, Threshold(80, 100)).collect() if r.n_shingles > 1}
    assert found == {(3, 3), (5, 3), (5, 5), (9, 5), (None, 3)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    expected = [(3, one), (5, other), (11, "x"), (11, None), (None, one)]
    assert rows(kept, "doc_id", "text") == sorted(expected, key=repr)


def test_fine_outlines_never_hide_a_pair_and_tell_long_sets_apart():
    draw = np.random.default_rng(4)
    threshold = Threshold(80, 100)
    base = [np.unique(draw.integers(0, 2**64, n, dtype=np.uint64)) for n in (30, 700, 1023, 1025, 5000, 9000)]
    sets = base + [np.unique(np.concatenate([s[len(s) // 10 :], draw.integers(0, 2**64, len(s) // 12, dtype=np.uint64)])) for s in base]
    sets += [np.unique(draw.integers(0, 2**64, n, dtype=np.uint64)) for n in (5000, 4900, 9000, 16000)]
    cell = pd.DataFrame(
        {"group": 1, "node": np.arange(len(sets)), "n": [len(s) for s in sets], "chunk": 0, "packed": [ngram_join._fine_outline(s) for s in sets]}
    )
    run = ngram_join._finely_tied(threshold)
    for chunks, cells in ((1, [(0, 0)]), (3, [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)])):
        cell["chunk"] = np.arange(len(sets)) % chunks
        edges = pd.concat([run((1, a, b), cell[cell["chunk"].isin((a, b))]) for a, b in cells])
        tied = {frozenset(e) for e in edges.itertuples(index=False, name=None)}
        assert tied == {frozenset((i, i + len(base))) for i in range(len(base))}
    wide = pd.DataFrame({"group": [1, 1], "node": [1, 2], "n": [400, 400], "chunk": 0, "packed": [b"\xff" * 128, b"\xff" * 64 + b"\x01" * 64]})
    assert len(run((1, 0, 0), wide)) == 1  # counts that aren't known bound nothing


def test_linked_sets_share_a_signature():
    draw = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100), (1, 2)):
        threshold = Threshold(num, den)
        for _ in range(300):
            n = int(draw.integers(1, 300))
            one = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            drop = int(draw.integers(0, max(1, n // 3)))
            other = np.unique(np.concatenate([one[drop:], draw.integers(0, 2**63, int(draw.integers(0, 20))).astype(np.uint64)]))
            if not len(other) or np.array_equal(one, other):
                continue
            overlap = len(np.intersect1d(one, other))
            if threshold.links(overlap, len(one) + len(other)):
                assert np.intersect1d(signatures(one, threshold), signatures(other, threshold)).size


@pytest.mark.parametrize("turns", [1, 2, 6])
def test_linked_sets_that_leave_many_buckets_empty_share_a_signature(monkeypatch, turns):
    """Multiples of one number meet in few buckets, so sets deal their tokens anew."""
    monkeypatch.setattr(ngram_join, "TURNS", turns)
    draw = np.random.default_rng(6)
    for num in (80, 90):
        threshold, linked = Threshold(num, 100), 0
        for _ in range(400):
            n, factor = int(draw.integers(4, 400)), int(draw.choice([1, 12, 5040, 1 << 20]))
            one = np.unique(draw.integers(0, 2**40, n).astype(np.uint64) * np.uint64(factor))
            drop = int(draw.integers(0, max(1, n // 6)))
            more = draw.integers(0, 2**40, int(draw.integers(0, max(2, n // 9)))).astype(np.uint64) * np.uint64(factor)
            other = np.unique(np.concatenate([one[drop:], more]))
            overlap = len(np.intersect1d(one, other))
            if not np.array_equal(one, other) and threshold.links(overlap, len(one) + len(other)):
                linked += 1
                assert np.intersect1d(signatures(one, threshold), signatures(other, threshold)).size
        assert linked > 50


@pytest.mark.parametrize(("num", "low", "high"), [(80, 8, 30), (80, 500, 700), (80, 3000, 3300), (90, 9, 30), (90, 500, 700)])
def test_unrelated_sets_share_no_signature(num, low, high):
    """Signatures of empty buckets made blocks that grew with the number of sets, and their pairs with its square."""
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 2**64, int(draw.integers(low, high)), dtype=np.uint64)) for _ in range(300)]
    signed = np.concatenate([np.unique(signatures(s, Threshold(num, 100))) for s in sets])
    assert len(np.unique(signed)) == len(signed)


def test_ties_of_a_block_reach_what_hangs_together():
    """A chain of sets, each like the next only, and one set apart."""
    threshold, draw = Threshold(80, 100), np.random.default_rng(7)
    row = draw.integers(0, 2**64, 1400, dtype=np.uint64)
    sets = [np.unique(row[at : at + 400]) for at in range(0, 700, 40)] + [np.unique(draw.integers(0, 2**64, 400, dtype=np.uint64))]
    outlines = np.stack([np.frombuffer(ngram_join._outline(s), np.uint8) for s in sets])
    edges = ngram_join._tied(outlines, np.array([len(s) for s in sets]), threshold)
    assert len(edges) == len(sets) - 2
    assert {i for e in edges for i in e} == set(range(len(sets) - 1))


def test_a_bound_never_hides_a_pair():
    draw = np.random.default_rng(9)
    threshold = Threshold(1, 2)
    sets = [np.unique(draw.integers(0, 40, int(draw.integers(3, 25))).astype(np.uint64)) for _ in range(120)]
    found = {tuple(sorted((q, int(o)))) for q, others in ngram_join.linked_pairs(sets, threshold, group_sets=5) for o in others}
    expected = {
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if threshold.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b]))
    }
    assert found == expected


def test_words_are_cut_at_ascii_space_only():
    assert len(shingles("a\u00a0b c\x0bd", 1)) == 3
    assert len(shingles("a b", 3)) == 1


def test_the_filter_passes_what_was_put_in(spark):
    held = ngram_join._filter_of(spark.range(0, 3000, 3).select("id"))
    draws = np.array([r[0] for r in spark.sql("select xxhash64(id) from range(3000)").collect()])
    passed = held.holds(draws)
    assert passed[::3].all()
    assert passed.mean() < 0.4


@pytest.mark.parametrize(("largest", "batch"), [(4096, 5), (4096, 1), (3, 2), (3, 7)])
def test_blocks_are_tied_across_batches(monkeypatch, largest, batch):
    monkeypatch.setattr(ngram_join, "LARGEST_BLOCK", largest)
    draw = np.random.default_rng(8)
    threshold = Threshold(1, 2)
    sets = [np.unique(draw.integers(0, 2**63, 12).astype(np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[3:], draw.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets]
    rows = sorted((int(m), node) for m in range(9) for node in draw.choice(12, int(draw.integers(1, 9)), replace=False))
    rows += [(20, node) for node in range(12)]
    table = pd.DataFrame(rows, columns=["mark", "node"])
    held = list(ngram_join._members(iter([table.iloc[i : i + batch] for i in range(0, len(table), batch)])))
    members = pd.concat(held, ignore_index=True)
    assert members.equals(table[table.groupby("mark")["node"].transform("size") > 1].reset_index(drop=True))
    members["n"] = [len(sets[n]) for n in members["node"]]
    members["outline"] = [ngram_join._outline(sets[n]) for n in members["node"]]
    parts = [members.iloc[i : i + batch] for i in range(0, len(members), batch)]
    edges = pd.concat(list(ngram_join._forests(threshold)(iter(parts))), ignore_index=True)
    parent = list(range(12))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in zip(edges["a"], edges["b"], strict=True):
        parent[root(a)] = root(b)
    for _, block in members.groupby("mark"):
        for a in block["node"]:
            for b in block["node"]:
                if threshold.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b])):
                    assert root(a) == root(b)
