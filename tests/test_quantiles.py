from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillsight.functions.quantiles import exact_quantiles, quartile_score

FRACTIONS = (0.0, 0.25, 0.5, 0.75, 1.0)


@pytest.mark.parametrize("rows,accuracy", [(1, 10000), (2, 10000), (7, 3), (3000, 10000), (3000, 4)])
def test_equals_interpolated_quantiles(spark, rows, accuracy):
    """Even a very coarse sketch gives exact results."""
    rng = np.random.default_rng(rows)
    data = pd.DataFrame(
        {
            "spread": rng.normal(size=rows) * 1000,
            "few": rng.integers(0, 4, rows).astype(float),
            "hot": np.where(rng.random(rows) < 0.4, 2.5, rng.exponential(size=rows)),
        }
    )
    found = exact_quantiles(spark.createDataFrame(data), list(data), FRACTIONS, accuracy).first()
    for name in data:
        assert np.allclose(found[name], data[name].quantile(list(FRACTIONS)), rtol=0, atol=1e-9)


def test_nulls_are_skipped(spark):
    data = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    found = exact_quantiles(data, ["a", "b"], (0.5,)).first()
    assert found.a == [2.0] and found.b is None


def test_scores_split_at_the_edges(spark):
    edges = F.array(*[F.lit(float(e)) for e in (0, 10, 20, 30, 40)])
    data = spark.createDataFrame([(float(v),) for v in (0, 10, 11, 20, 30, 31, 40)], "v double")
    rows = data.select(
        quartile_score(F.col("v"), edges).alias("up"),
        quartile_score(F.col("v"), edges, reverse=True).alias("down"),
    ).collect()
    assert [r.up for r in rows] == [1, 1, 2, 2, 3, 4, 4]
    assert [r.down for r in rows] == [4, 4, 3, 3, 2, 1, 1]


def test_repeated_edges_give_the_neutral_score(spark):
    edges = F.array(*[F.lit(float(e)) for e in (0, 0, 1, 3, 11)])
    data = spark.createDataFrame([(0.0,), (11.0,)], "v double")
    assert [r.s for r in data.select(quartile_score(F.col("v"), edges).alias("s")).collect()] == [2.0, 2.0]
