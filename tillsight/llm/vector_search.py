"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to a table of pivots are computed once.  For a query
``q`` and a candidate ``v`` the triangle inequality gives ``d(q, v) >= max over
pivots p of |d(q, p) - d(v, p)|``, and as ``2 q.v = |q|^2 + |v|^2 - d(q, v)^2``
this lower bound of the distance is an upper bound of the score.  Candidates are
evaluated in the order of their bounds until the next bound is below the k-th
best score, so the result is exact.

Queries and candidates meet in a grid of blocks: a task holds at most
``query_block`` queries and ``candidate_block`` candidates, whatever the sizes
of the tables, and hands on k rows for each of its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Scratch

PIVOTS = 32
PIVOT_POOL = 512
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
FIRST = 128
FOUND = "query_row long, vec_id long, score long"
# Sums of products up to here are exact in doubles.
EXACT = 2.0**53


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component x, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """A vector that is not null and holds only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def as_matrix(vectors, width: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector is filled up with zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row to every pivot."""
    if not len(pivots):
        return np.zeros((len(rows), 0))
    a, b = rows.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the farthest from those taken."""
    if not len(pool):
        return pool
    taken = [0]
    nearest = distances(pool, pool[:1])[:, 0]
    while len(taken) < count and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(pool, pool[taken[-1] :][:1])[:, 0])
    return pool[taken]


def inner(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Integer inner products; by way of doubles where these are exact."""
    if not matrix.size:
        return np.zeros(len(matrix), dtype=np.int64)
    largest = float(np.abs(matrix).max()) * float(np.abs(vector).max()) * matrix.shape[1]
    if largest < EXACT:
        return (matrix.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return matrix @ vector


def search_block(
    query_rows: np.ndarray,
    queries: np.ndarray,
    query_table: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    table: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block for each query, ties to the smaller id: the query's row, id and score.

    A query's own row is left out, other rows with its id are not.  Bounds get a
    margin for the rounding of doubles.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    for query_row, query, own in zip(query_rows, queries, query_table, strict=True):
        norm = float((query.astype(np.float64) ** 2).sum())
        low = np.abs(table - own).max(axis=1) if table.shape[1] else np.zeros(len(ids))
        top = (norms + norm - low * low) / 2.0
        bound = top + 1.0 + 1e-9 * (norms + norm)
        bound[rows == query_row] = -np.inf
        order = np.argsort(-bound, kind="stable") if len(ids) <= FIRST else np.argpartition(-bound, FIRST)[:FIRST]
        order = order[bound[order] > -np.inf]
        best_ids, best = ids[order], inner(vectors[order], query)
        rank = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[rank], best[rank]
        if len(ids) > FIRST:
            seen = np.zeros(len(ids), dtype=bool)
            seen[order] = True
            floor = best[-1] if len(best) == k else -np.inf
            rest = np.flatnonzero(~seen & (bound >= floor) & (bound > -np.inf))
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            for start in range(0, len(rest), 4 * FIRST):
                part = rest[start : start + 4 * FIRST]
                if len(best) == k and bound[part[0]] < best[-1]:
                    break  # no later candidate can reach the k-th score
                all_ids = np.concatenate([best_ids, ids[part]])
                scores = np.concatenate([best, inner(vectors[part], query)])
                rank = np.lexsort((all_ids, -scores))[:k]
                best_ids, best = all_ids[rank], scores[rank]
        found.append((np.full(len(best), query_row), best_ids, best))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))  # type: ignore[return-value]


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    scale: float = 256.0,
    scratch: Scratch | None = None,
) -> DataFrame:
    """For each query row its ``k`` best other rows by integer inner product.

    Returns query_id long, rank int (from 1), vec_id long, score long.  Vectors
    that are null, or hold null or non-finite components, and rows without an
    id take no part.  Shorter vectors count as filled up with zeros.  Rows that
    share an id are candidates one by one, of each other too, and queries of
    their own, each with its ranks.  Scores beyond 64 bits wrap.  An empty table gives
    an empty result; other columns are ignored.

    The pivots are picked from at most ``PIVOT_POOL`` rows (those with the
    smallest hashes of their ids); every row is indexed, and any choice of
    pivots gives the same result.
    """
    spark = rows.sparkSession
    points = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"),
        quantised(F.col(vector_col), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    sizes = points.agg(
        F.count("*").alias("rows"),
        F.count_if("asks").alias("queries"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
    ).first()
    width = int(sizes["width"])
    pool = points.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(PIVOT_POOL).collect()
    table = choose_pivots(as_matrix([row["vector"] for row in pool], width), pivots)
    query_blocks = max(1, math.ceil(sizes["queries"] / query_block))
    candidate_blocks = max(1, math.ceil(sizes["rows"] / candidate_block))

    def measured(batches):
        for block in batches:
            block["to_pivots"] = list(distances(as_matrix(list(block["vector"]), width), table))
            yield block

    indexed = points.mapInPandas(measured, "id long, vector array<long>, asks boolean, row long, to_pivots array<double>")
    scratch = scratch or Scratch(spark, "vector-search")
    indexed = scratch.table(indexed, "indexed")

    def part(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    candidates = indexed.select(
        "row", "id", "vector", "to_pivots", part(candidate_blocks).alias("c"), all_of(query_blocks).alias("q")
    )
    queries = indexed.where("asks").select(
        "row", "vector", "to_pivots", part(query_blocks).alias("q"), all_of(candidate_blocks).alias("c")
    )

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = search_block(
            asked["row"].to_numpy(),
            as_matrix(list(asked["vector"]), width),
            np.array(list(asked["to_pivots"]), dtype=np.float64).reshape(len(asked), -1),
            held["row"].to_numpy(),
            held["id"].to_numpy(),
            as_matrix(list(held["vector"]), width),
            np.array(list(held["to_pivots"]), dtype=np.float64).reshape(len(held), -1),
            k,
        )
        return pd.DataFrame(dict(zip(("query_row", "vec_id", "score"), found, strict=True)))

    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(cell, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = indexed.where("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return ranked.join(named, "query_row").select("query_id", "rank", "vec_id", "score")
