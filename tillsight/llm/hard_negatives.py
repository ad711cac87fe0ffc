"""Hard negatives by matrix products in a residue number system.

Scores are inner products of whole numbers.  A block of anchors meets a block of
candidates as matrices of their components modulo several small primes, centred
around 0.  Those are multiplied in single precision, in slices of the width
whose sums stay below 2**24 and are exact.  From a score's residues the Chinese
remainder theorem gives back the exact signed score, as long as the product of
the primes exceeds twice the largest possible one; the primes are taken until it
does.

One pass finds each anchor's positives, the best rows of its label.  A second
pass takes, for each of them, the best rows of other labels within a window
below the positive's score.  In both a task holds one block of each side, and
hands on as many rows as are asked for; windows over these pick the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Scratch
from .vector_search import quantised, usable

# Primes are taken downwards from here.
LARGEST_PRIME = 251
ANCHOR_BLOCK, CANDIDATE_BLOCK = 16384, 8192
# Anchors whose scores a task holds at a time.
SLICE = 128
# Whole numbers up to here are exact in single precision.
EXACT = 2**24


@dataclass(frozen=True)
class Band:
    """Negatives with low * positive <= 100 * negative <= high * positive."""

    low: int = 50
    high: int = 95

    def limits(self, positive: int) -> tuple[int, int]:
        """The smallest and largest score allowed; none lies between if the positive's is negative."""
        return -(-self.low * positive // 100), self.high * positive // 100


def primes_for(largest_score: int, start: int = LARGEST_PRIME) -> list[int]:
    """Primes downwards from ``start`` whose product exceeds 2 * ``largest_score``."""
    taken, product = [], 1
    for number in range(start, 2, -1):
        if all(number % d for d in range(2, math.isqrt(number) + 1)):
            taken.append(number)
            product *= number
            if product > 2 * largest_score:
                return taken
    raise ValueError("scores are too large for these primes")


def residues(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Centred residues, from -(prime // 2) to prime // 2, in single precision."""
    out = np.mod(matrix, prime)
    return np.where(out > prime // 2, out - prime, out).astype(np.float32)


def product_modulo(one: np.ndarray, other: np.ndarray, prime: int) -> np.ndarray:
    """one @ other.T modulo ``prime``, from 0, of centred residues."""
    step = EXACT // (prime // 2) ** 2
    out = np.zeros((len(one), len(other)), np.int64)
    for at in range(0, one.shape[1], step):
        out += (one[:, at : at + step] @ other[:, at : at + step].T).astype(np.int64)
    return np.mod(out, prime)


def reconstructed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed numbers from their residues; beyond 64 bits they wrap.

    The digits of a mixed radix system follow from the residues one by one; a
    number above half of the primes' product stands for a negative one.
    """
    digits: list[np.ndarray] = []
    for part, prime in zip(parts, primes, strict=True):
        digit = part
        for earlier, radix in zip(digits, primes, strict=False):
            digit = np.mod((digit - earlier) * pow(radix, -1, prime), prime)
        digits.append(digit)
    half, weight = math.prod(primes) // 2, 1
    number = np.zeros(parts[0].shape, np.uint64)
    above = np.zeros(parts[0].shape, bool)
    for digit, prime in zip(digits, primes, strict=True):
        number += digit.astype(np.uint64) * np.uint64(weight % 2**64)
        limit = half // weight % prime  # the digit of half; later digits weigh more
        above = (digit > limit) | ((digit == limit) & above)
        weight *= prime
    number[above] -= np.uint64(weight % 2**64)
    return number.view(np.int64)


def scores(anchors: np.ndarray, candidates: np.ndarray, primes: list[int]) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers."""
    return _scores([residues(anchors, p) for p in primes], [residues(candidates, p) for p in primes], primes)


def _scores(anchors: list[np.ndarray], candidates: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return reconstructed([product_modulo(a, c, p) for a, c, p in zip(anchors, candidates, primes, strict=True)], primes)


def best(found: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """The places ``found`` of the ``count`` highest values of ``row``, ties in the order of ``found``."""
    if len(found) > 4 * count:
        kept = row[found]
        found = found[kept >= np.partition(kept, len(kept) - count)[len(kept) - count]]
    return found[np.argsort(-row[found], kind="stable")[:count]]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector is filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _slices(asked: pd.DataFrame, held: pd.DataFrame, width: int, primes: list[int]):
    """The anchors of a block one by one, with their scores of all held rows."""
    others = [residues(_matrix(held["vector"], width), p) for p in primes]
    for start in range(0, len(asked), SLICE):
        part = asked.iloc[start : start + SLICE]
        matrix = _matrix(part["vector"], width)
        block = _scores([residues(matrix, p) for p in primes], others, primes)
        yield from zip(part.itertuples(index=False), block, strict=True)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype("int64")


class Mining:
    """The rows that take part, in a table of the shared folder, and the primes that hold their scores."""

    def __init__(self, rows: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str, scale: float, scratch: Scratch):
        """Components become floor(scale * x); rows with a null id, label or vector,
        or a null or non-finite component, are left out."""
        taking_part = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col)))
        points = taking_part.select(
            F.col(id_col).cast("long").alias("id"),
            label.cast("long").alias("label"),
            quantised(F.col(vector_col), scale).alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        )
        # Rows that share an id are rows of their own.
        self.points = scratch.table(points.withColumn("row", F.monotonically_increasing_id()), "points")
        whole = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
        sizes = self.points.agg(
            F.count("*").alias("rows"),
            F.count_if("asks").alias("anchors"),
            F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
            F.coalesce(F.max(whole), F.lit(0.0)).alias("norm"),
        ).first()
        self.width = max(1, sizes["width"])
        # No score exceeds the largest squared length; a little more for the rounding of doubles.
        self.primes = primes_for(int(sizes["norm"] * (1 + 1e-9)) + 1)
        self.rows, self.anchors = sizes["rows"], sizes["anchors"]

    def grid(self, anchors: DataFrame, anchor_block: int, candidate_block: int):
        """Anchors and candidates as the two sides of a grid of blocks, ready to be cogrouped."""
        across, down = (max(1, math.ceil(n / size)) for n, size in ((self.anchors, anchor_block), (self.rows, candidate_block)))

        def block(count: int) -> Column:
            return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

        def all_of(count: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

        asked = anchors.withColumns({"a": block(across), "c": all_of(down)})
        held = self.points.select("row", "id", "label", "vector", block(down).alias("c"), all_of(across).alias("a"))
        return asked.groupBy("a", "c").cogroup(held.groupBy("a", "c"))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    band: Band = Band(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    anchor_block: int = ANCHOR_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    scratch: Scratch | None = None,
) -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels within ``band``.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score.  A row's score is its inner product with the anchor, of
    whole components; higher scores come first, ties by smaller id.  Positives
    are the first other rows of the anchor's label.  A positive without a row in
    its band gives no row.  Rows that share an id take part one by one, as
    anchors too, so repeated rows give repeated results; shorter vectors count
    as filled up with zeros; components beyond 64 bits count as the last whole
    number there, and scores beyond wrap.  An empty table gives an empty
    result; other columns are ignored.
    """
    scratch = scratch or Scratch(rows.sparkSession, "hard-negatives")
    mining = Mining(rows, is_anchor, label, id_col, vector_col, scale, scratch)
    width, primes = mining.width, mining.primes
    # Aliases, as anchors meet the table that they come from.
    anchors = mining.points.where("asks").select(*[F.col(c).alias(c) for c in ("row", "id", "label", "vector")])

    def near(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id")
        ids, labels, keys = (held[c].to_numpy() for c in ("id", "label", "row"))
        out = []
        for anchor, row in _slices(asked, held, width, primes):
            found = best(np.flatnonzero((labels == anchor.label) & (keys != anchor.row)), row, positives)
            out += [(anchor.row, ids[i], row[i]) for i in found]
        return _frame(out, ["row", "positive_id", "positive_score"])

    def hard(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id")
        ids, labels = (held[c].to_numpy() for c in ("id", "label"))
        out = []
        for anchor, row in _slices(asked, held, width, primes):
            other = labels != anchor.label
            for place, score in enumerate(anchor.positives):
                low, high = band.limits(int(score))
                found = best(np.flatnonzero(other & (row >= low) & (row <= high)), row, negatives)
                out += [(anchor.row, place + 1, ids[i], row[i]) for i in found]
        return _frame(out, ["row", "place", "negative_id", "negative_score"])

    by_score = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    candidates = mining.grid(anchors, anchor_block, candidate_block).applyInPandas(near, "row long, positive_id long, positive_score long")
    nearest = scratch.table(
        candidates.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives), "positives"
    )
    # At most ``positives`` rows for each anchor.
    gathered = nearest.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("found"))
    asking = anchors.join(gathered.select("row", F.col("found.positive_score").alias("positives")), "row")
    windows = mining.grid(asking, anchor_block, candidate_block).applyInPandas(hard, "row long, place long, negative_id long, negative_score long")
    by_negative = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = windows.withColumn("rank", F.row_number().over(by_negative)).where(F.col("rank") <= negatives)
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    return (
        ranked.join(nearest.withColumn("place", F.col("place").cast("long")), ["row", "place"])
        .join(named, "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
