from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, rank int, anchor_id long"


def frame(spark, data):
    return spark.createDataFrame([(*row, "clash", 7, 7) for row in data], SCHEMA)


def mined(spark, data, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hn.mine(frame(spark, data), F.col("vec_id") % 5 == 0, label, **options)
    return sorted(tuple(r) for r in found.collect())


def plain(data, positives=5, negatives=3):
    rows = []
    for vec, values, label in data:
        if None in (vec, values, label) or not all(v is not None and math.isfinite(v) for v in values):
            continue
        rows.append((vec, [math.floor(256 * float(np.float32(v))) for v in values], (label + 1) % 10 if vec % 7 == 0 else label))
    out = []
    for n, (anchor, own, label) in enumerate(rows):
        if anchor % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(own, v, strict=False)), i, k == label) for m, (i, v, k) in enumerate(rows) if m != n]
        for score, positive in sorted((s, i) for s, i, same in scored if same)[:positives]:
            other = sorted((s, i) for s, i, same in scored if not same and 50 * -score <= 100 * -s <= 95 * -score)
            out += [(anchor, positive, rank + 1, i, -score, -s) for rank, (s, i) in enumerate(other[:negatives])]
    return sorted(out)


def vectors(count, width=6, seed=1, labels=3):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in draw.normal(size=width)], int(draw.integers(labels))) for i in range(count)]


@pytest.mark.parametrize(("anchor_block", "candidate_block"), [(16384, 8192), (13, 50)])
def test_mining_matches_all_pairs(spark, anchor_block, candidate_block):
    data = vectors(300) + [(400 + i, [0.5] * 6, i % 2) for i in range(30)]
    data += [(500, None, 1), (505, [1.0, None], 1), (510, [float("nan")] * 6, 1), (515, [float("inf")], 2), (520, [], 1), (525, [1.0, 2.0], 0)]
    data += [(530, [1.0] * 6, None), (None, [1.0] * 6, 1), (0, [2.0] * 6, 1), *vectors(3)]
    expected = plain(data)
    assert mined(spark, data, anchor_block=anchor_block, candidate_block=candidate_block) == expected
    assert len(expected) > 100


def test_no_rows_no_anchors_no_positives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 0), (2, [0.9], 1)]) == []
    one = [(5, [1.0, 0.0], 0), (6, [1.0, 0.0], 0), (8, [0.75, 5.0], 1)]
    assert mined(spark, one) == plain(one) == [(5, 6, 1, 8, 65536, 49152)]


def test_negative_positives_have_no_window(spark):
    data = [(5, [1.0], 0), (6, [-1.0], 0), (8, [-0.75], 1), (9, [-1.25], 1)]
    assert mined(spark, data) == plain(data) == []


def test_zero_scores_stand_in_a_window_of_zero(spark):
    data = [(5, [1.0, 0.0], 0), (6, [0.0, 1.0], 0), (8, [0.0, 2.0], 1), (9, [0.0, -2.0], 1)]
    assert mined(spark, data) == plain(data) == [(5, 6, 1, 8, 0, 0), (5, 6, 2, 9, 0, 0)]


@pytest.mark.parametrize("largest", [1, 100, 2**12, 2**25, 2**30])
def test_products_are_exact(largest):
    draw = np.random.default_rng(largest)
    one, other = (draw.integers(-largest, largest + 1, (n, 70)) for n in (9, 13))
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in other] for x in one]
    bound = 70 * largest * largest
    found = hn.scores(one, other, hn.primes_for(bound))
    if bound < 2**63:
        assert found.tolist() == exact
    else:
        assert found.tolist() == [[(v + 2**63) % 2**64 - 2**63 for v in row] for row in exact]


def test_wide_matrices_are_summed_in_exact_slices():
    one = np.full((2, 5000), 125)
    one[1] *= -1
    found = hn.scores(one, one, hn.primes_for(125 * 125 * 5000))
    assert found.tolist() == [[78_125_000, -78_125_000], [-78_125_000, 78_125_000]]


def test_numbers_at_the_ends_of_the_range():
    primes = hn.primes_for(30_000)
    end = math.prod(primes) // 2
    numbers = np.array([[0, 1, -1, end, -end, end - 1]])
    assert hn.reconstructed([np.mod(numbers, p) for p in primes], primes).tolist() == numbers.tolist()


def test_primes_cover_the_scores():
    for largest in (1, 31_000, 10**9, 2**70):
        primes = hn.primes_for(largest)
        assert math.prod(primes) > 2 * largest and len(set(primes)) == len(primes)
    with pytest.raises(ValueError, match="too large"):
        hn.primes_for(10**9, start=7)


def test_large_components_stay_exact(spark):
    big = float(2**26)
    data = [(5, [big, 1.0], 0), (6, [1.0, 3.0], 0), (8, [0.75, 1.0], 1)]
    assert mined(spark, data) == plain(data) == [(5, 6, 1, 8, 2**34 * 256 + 256 * 768, 2**34 * 192 + 65536)]
