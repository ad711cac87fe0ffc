"""RFM scoring, segment reports and churn probability."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import segments
from ..functions.quantiles import quantiles_of, quartile_score
from ..functions.recency import days_before_latest, sold_before, sold_since
from ..functions.scalars import attach

WINDOW_DAYS = 30
CHURN_DECAY = 0.05
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def recent_activity(
    sales: DataFrame,
    window_days: int = WINDOW_DAYS,
    as_of: dt.datetime | None = None,
    last_day: dt.date | None = None,
) -> DataFrame:
    """Recency, frequency and monetary value per customer in the window.

    The window ends at ``as_of``, by default at the latest sale of all (see
    ``days_before_latest``); recency counts whole elapsed days back from the
    latest sale of a known customer inside it.
    """
    recent = sold_since(sales, days_before_latest(sales, window_days, as_of, last_day))
    if as_of is not None:
        recent = sold_before(recent, F.lit(as_of + dt.timedelta(microseconds=1)).cast("timestamp_ntz"))
    folded = (
        recent.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max("timestamp").alias("last_sale"),
            F.count("*").alias("frequency"),
            F.coalesce(F.sum("net_amount"), F.lit(0)).alias("monetary"),
        )
    )
    # The whole struct, so that this reader needs the same columns as the other
    # one and both share one shuffle of the sales.
    reference = folded.agg(F.max(F.struct("last_sale", "frequency", "monetary"))["last_sale"]).scalar()
    return folded.select(
        "customer_id",
        F.timestamp_diff("DAY", F.col("last_sale"), reference).alias("recency"),
        "frequency",
        "monetary",
    )


def rfm_scores(sales: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Quartile scores per customer and the segment of their sum."""
    return score_activity(recent_activity(sales, window_days))


def score_activity(activity: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``rfm_scores`` from an activity table, which is read several times.

    With ``accuracy`` the quartiles come from a sketch, see ``sketched_quantiles``.
    """
    edges = F.col("edges")
    measures = ("recency", "frequency", "monetary")
    scored = attach(activity, quantiles_of(activity, measures, QUARTILES, accuracy), "edges").withColumns(
        {
            "recency_score": quartile_score(F.col("recency"), edges["recency"], reverse=True),
            "frequency_score": quartile_score(F.col("frequency"), edges["frequency"]),
            "monetary_score": quartile_score(F.col("monetary").cast("double"), edges["monetary"]),
        }
    ).withColumn(
        "rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    )
    return scored.withColumn("segment", segments.rfm_segment(F.col("rfm_score"))).drop("edges")


def rfm_segment_summary(scores: DataFrame) -> DataFrame:
    """Customers per segment and their share; all four segments appear."""
    counts = scores.agg(
        F.count("*").alias("customers"),
        *[F.count_if(F.col("segment") == name).alias(name) for name in segments.RFM_SEGMENTS],
    )
    listed = counts.select(
        "customers",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("segment"), F.col(name).alias("customer_count"))
                    for name in segments.RFM_SEGMENTS
                ]
            )
        ),
    )
    share = F.coalesce(F.try_divide("customer_count", "customers") * 100, F.lit(0.0))
    return listed.select("segment", "customer_count", F.bround(share, 2).alias("percentage"))


def rfm_segment_revenue(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("segment")
        .agg(F.sum("monetary").alias("monetary"))
        .orderBy("monetary", "segment")
    )


def churn_by_segment(sales: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Mean churn probability by segment.

    These segments come from the monetary quartile alone and are not those
    of ``rfm_scores``.
    """
    return churn_of_activity(recent_activity(sales, window_days))


def churn_of_activity(activity: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``churn_by_segment`` from an activity table, which is read several times."""
    # Recency rides along so that both readers of the activity need the same
    # columns and share one shuffle of the sales.
    edges = quantiles_of(activity, ["recency", "monetary"], QUARTILES, accuracy)
    quartile = quartile_score(F.col("monetary").cast("double"), F.col("edges.monetary"))
    names = dict(zip((4, 3, 2, 1), segments.RFM_SEGMENTS))
    segment = F.when(quartile >= 4, names[4]).when(quartile >= 3, names[3]).when(
        quartile >= 2, names[2]
    ).otherwise(names[1])
    return (
        attach(activity, edges, "edges")
        .select(segment.alias("segment"), churn_probability(F.col("recency")).alias("p"))
        .groupBy("segment")
        .agg(F.avg("p").alias("churn_probability"))
    )


def churn_probability(recency_days: Column) -> Column:
    return 1 - F.exp(-CHURN_DECAY * recency_days)
