"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Starting from one
rate for all, the cells' inclusion probabilities are raked to the marginal
targets of each dimension in turn, never above 1, until the targets are met.  A
document is then drawn with its cell's probability, by a hash of its id.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Scratch

# Sweeps that are always made, by default.  More follow until no value's share of
# the sample is further than TOLERANCE from its target, as long as they bring the
# largest distance down (targets that need a probability above 1 are never met),
# and MOST_SWEEPS at most.
SWEEPS = 8
TOLERANCE = 1e-3
LEAST_GAIN = 1e-6
MOST_SWEEPS = 400
# Sweeps that one plan holds before the cells are written.
STRIDE = 4
PLACES = 9
NONE = "(none)"


@dataclass(frozen=True)
class Mix:
    """What the sample should look like.

    ``rate`` is the share of all tokens to draw.  A dimension's targets are the
    given weights of its values, or else its values' token shares to the power
    ``flatten``.  A value that the weights don't name, ``(none)`` included,
    keeps its own share of the tokens; the named ones divide what is left.  Only
    a weight of 0 excludes a value.
    """

    rate: float = 0.5
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    flatten: Mapping[str, float] = field(default_factory=dict)


def token_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def draw(key: Column) -> Column:
    """An even number below 1 from a key; a null key counts as an empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def _targets(cells: DataFrame, dimension: str, mix: Mix) -> Column:
    """The weight of the value that a cell has in a dimension, not yet scaled; null if none is given."""
    given = mix.weights.get(dimension)
    if given:
        pairs = [part for value, weight in given.items() for part in (F.lit(value), F.lit(float(weight)))]
        return F.create_map(*pairs)[F.col(dimension)]
    power = float(mix.flatten.get(dimension, 1.0))
    return F.pow(F.sum("tokens").over(Window.partitionBy(dimension)).cast("double"), F.lit(power))


def _unmet(cells: DataFrame, dimensions: list[str], goal: float) -> float:
    """The largest distance of a value's share of the sample from its target."""
    gaps = [
        F.when(
            F.sum("tokens").over(Window.partitionBy(d)) > 0,
            F.abs(F.sum(F.col("p") * F.col("tokens")).over(Window.partitionBy(d)) - F.col(f"weight_{d}")) / goal,
        )
        for d in dimensions
    ]
    return cells.select(F.greatest(F.lit(0.0), *gaps).alias("gap")).agg(F.max("gap")).first()[0] or 0.0


def calibrate(
    cells: DataFrame, dimensions: list[str], mix: Mix, scratch: Scratch, sweeps: int = SWEEPS
) -> DataFrame:
    """Cells (dimensions, tokens) with their probability.

    The cells are as many as there are combinations of values, however many
    documents there are; windows group them by one value.  At least ``sweeps``
    sweeps are made; a warning tells how far off targets are that can't be met.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for dimension in dimensions:
        weight = _targets(cells, dimension, mix)
        cells = cells.withColumn(f"weight_{dimension}", weight)
    cells = scratch.table(cells.withColumn("p", F.lit(float(mix.rate))), "cells-0")
    for dimension in dimensions:
        weight = F.col(f"weight_{dimension}")
        # Each value counts once: by the share that a cell has in its value.
        share = weight * F.col("tokens") / F.col("of_value")
        sums, rest = (
            cells.withColumn("of_value", F.sum("tokens").over(Window.partitionBy(dimension)))
            .where("of_value > 0")
            .agg(F.sum(share), F.sum(F.when(weight.isNull(), F.col("tokens"))))
            .first()
        ) or (None, None)
        scale = mix.rate * (total - (rest or 0)) / sums if sums else 0.0
        own = mix.rate * F.sum("tokens").over(Window.partitionBy(dimension))
        cells = cells.withColumn(f"weight_{dimension}", F.coalesce(weight * scale, own.cast("double")))
    done, gap, best = 0, None, cells
    while total and mix.rate:
        for _ in range(min(STRIDE, sweeps - done) if done < sweeps else STRIDE):
            done += 1
            for dimension in dimensions:
                drawn = F.sum(F.col("p") * F.col("tokens")).over(Window.partitionBy(dimension))
                cells = cells.withColumn("drawn", drawn).withColumn(
                    "p",
                    F.when(F.col("drawn") > 0, F.least(F.lit(1.0), F.col("p") * F.col(f"weight_{dimension}") / F.col("drawn")))
                    .otherwise(F.col("p")),
                )
        cells = scratch.table(cells.drop("drawn"), f"cells-{done}")
        if done < sweeps:
            continue
        before, gap = gap, _unmet(cells, dimensions, mix.rate * total)
        if before is not None and before - gap < LEAST_GAIN:
            gap = before  # nothing gained: the sweeps before stand
            break
        best = cells
        if gap <= TOLERANCE or done >= MOST_SWEEPS:
            break
    if gap is not None and gap > TOLERANCE:
        warnings.warn(f"mixing: a value's share of the sample is {gap:.4f} off its target", stacklevel=2)
    cells = best
    # Rounding may not take a document's last chance.
    least = F.when(F.col("p") > 0, F.lit(10.0**-PLACES)).otherwise(F.lit(0.0))
    probability = F.greatest(F.round("p", PLACES), least).alias("probability")
    return cells.select(*dimensions, "tokens", probability)


def sample(
    docs: DataFrame,
    topic: Column,
    mix: Mix,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    scratch: Scratch | None = None,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """The drawn rows of ``docs`` with mix_topic, mix_tokens, mix_probability and mix_weight.

    ``mix_weight`` (1 / probability) makes sums over the sample estimate sums
    over all rows.  Null sources, languages and topics are the value
    ``(none)``.  Null and empty texts have no tokens; they are drawn with the
    probability of their cell.  Rows that repeat an id are drawn together, and so
    are those without one.  Columns of ``docs`` that have one of the four names
    give way to the new ones; others may have any name.  An empty table gives an
    empty sample.  The sums are formed before the shuffle; the rows themselves
    only meet the table of cells.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    made = ("mix_topic", "mix_tokens", "mix_probability", "mix_weight")
    own = [c for c in docs.columns if c not in made]
    names = ["source", "lang", "topic"]
    placed = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(c) for c in own]).alias("doc"),
        F.coalesce(F.col(source_col), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang_col), F.lit(NONE)).alias("lang"),
        F.coalesce(topic, F.lit(NONE)).alias("topic"),
        token_count(F.col(text_col)).alias("tokens"),
        draw(F.col(id_col)).alias("draw"),
    )
    cells = scratch.table(placed.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = scratch.table(calibrate(cells, names, mix, scratch, sweeps), "fitted")
    drawn = placed.join(fitted.select(*names, "probability"), names).where(F.col("draw") < F.col("probability"))
    return drawn.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in own],
        F.col("topic").alias("mix_topic"),
        F.col("tokens").alias("mix_tokens"),
        F.col("probability").alias("mix_probability"),
        F.round(1 / F.col("probability"), 6).alias("mix_weight"),
    )
