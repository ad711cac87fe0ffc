"""Benchmark decontamination by greedy string tiling.

Runs of a few tokens that a document shares with a test item are the seeds.
Seeds that continue each other make maximal matches; the longest match whose
tokens are all unmarked is marked in both texts, again and again, until none of
seed length is left.  The share of an item's tokens that end up marked is its
coverage, which doesn't ask in which order the tiles stand in the document.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .storage import Shared, by_place, small_batches

SEED = 5
COVERAGE = 0.6
# Characters of test items that are sent to the executors at a time.
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, coverage double, covered long, item_tokens long, tiles long"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in small letters; signs don't count."""
    digest = xxhash.xxh3_64_intdigest
    words = WORD.findall((text or "").lower())
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def running(values: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` tokens."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for shift in range(length):
        out = out * BASE + values[shift : shift + count]
    return out


def tile(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, tokens), the longest first; equals from the left.

    ``seeds`` are the places where runs of ``length`` tokens agree.
    """
    diagonals: dict[int, list[int]] = defaultdict(list)
    for i, j in seeds:
        diagonals[i - j].append(i)
    matches: list[tuple[int, int, int]] = []

    def push(i: int, j: int, size: int) -> None:
        if size >= length:
            heapq.heappush(matches, (-size, i, j))

    for shift, places in diagonals.items():
        places.sort()
        start = last = places[0]
        for i in [*places[1:], -1]:
            if i != last + 1:
                size = last - start + length
                # Equal hashes are not yet equal words.
                if np.array_equal(text[start : start + size], item[start - shift : start - shift + size]):
                    push(start, start - shift, size)
                start = i
            last = i
    in_text, in_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    found = []
    while matches:
        size, i, j = heapq.heappop(matches)
        size = -size
        taken = in_text[i : i + size] | in_item[j : j + size]
        if not taken.any():
            in_text[i : i + size] = True
            in_item[j : j + size] = True
            found.append((i, j, size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            push(i + a, j + a, b - a)
    return found


@dataclass
class ItemTables:
    """Items and, for each length of seeds, the sorted hashes of their runs."""

    ids: list[int | None]
    texts: list[np.ndarray]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], seed: int) -> ItemTables:
        held = [(i, t) for i, text in rows if len(t := tokens(text))]
        ids, texts = [i for i, _ in held], [t for _, t in held]
        by_length: dict[int, list[int]] = defaultdict(list)
        for number, text in enumerate(texts):
            by_length[min(seed, len(text))].append(number)  # shorter items have to match whole
        tables = {}
        for length, numbers in by_length.items():
            runs = [running(texts[n], length) for n in numbers]
            keys = np.concatenate(runs)
            owner = np.repeat(numbers, [len(r) for r in runs])
            place = np.concatenate([np.arange(len(r)) for r in runs])
            order = np.argsort(keys, kind="stable")
            tables[length] = keys[order], owner[order], place[order]
        return cls(ids, texts, tables)

    def matches(self, text: str | None, least: float) -> Iterator[tuple[int | None, float, int, int, int]]:
        """Items covered to at least ``least``: id, coverage, covered tokens, tokens, tiles."""
        words = tokens(text)
        for length, (keys, owner, place) in self.tables.items():
            own = running(words, length)
            low = np.searchsorted(keys, own, "left")
            inside = low < len(keys)
            hit = np.flatnonzero(inside & (keys[np.where(inside, low, 0)] == own))
            if not len(hit):
                continue
            high = np.searchsorted(keys, own[hit], "right")
            seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for i, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for at in range(a, b):
                    seeds[int(owner[at])].append((i, int(place[at])))
            for number in sorted(seeds):
                item = self.texts[number]
                reachable = {j + n for _, j in seeds[number] for n in range(length)}
                if len(reachable) < least * len(item):
                    continue  # not even all seeds together cover enough
                tiles = tile(words, item, seeds[number], length)
                covered = sum(size for _, _, size in tiles)
                if covered >= least * len(item):
                    yield self.ids[number], covered / len(item), covered, len(item), len(tiles)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, seed: int, block_chars: int) -> Iterator[ItemTables]:
    """The benchmark in blocks of about ``block_chars`` characters each; repeated items count once."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for number in range(count):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        yield ItemTables.of([(row["item"], row["text"]) for row in mine.collect()], seed)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents that hold test items: doc_id, item_id, coverage, covered, item_tokens, tiles.

    One row for each document and item of which at least ``coverage`` of the
    tokens are tiled.  An item of fewer tokens than ``seed`` has to occur whole;
    one without tokens, and null or empty texts, match nothing.  An item without
    an id is reported with a null one; different items of one id are reported
    each.  Repeated documents give repeated results, repeated items don't.  Documents are read as they come, without a shuffle;
    a benchmark beyond ``block_chars`` characters is worked through in blocks.
    Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def against(items: ItemTables) -> DataFrame:
        shared = Shared(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in small_batches(batches):
                rows = [
                    (doc, *found)
                    for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)
                    for found in shared.value.matches(text, coverage)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                names = [part.split()[0] for part in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return texts.mapInArrow(run, FOUND)

    return reduce(DataFrame.union, map(against, item_blocks(benchmark, item_id_col, item_text_col, seed, block_chars)))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    seed: int = SEED,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without those that hold a test item (see ``leaks``), whether it has an id or not.

    No shuffle; all columns stay, whatever their names.  Documents with null or
    empty texts stay, repeated rows stay or go together, and without items all
    documents stay.
    """
    at = docs.columns.index(text_col)

    def without(rest: DataFrame, items: ItemTables) -> DataFrame:
        shared = Shared(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in small_batches(batches):
                clean = [
                    next(shared.value.matches(text, coverage), None) is None for text in block.column(at).to_pylist()
                ]
                yield block.filter(pa.array(clean, pa.bool_()))

        return rest.mapInArrow(run, rest.schema)

    blocks = item_blocks(benchmark, item_id_col, item_text_col, seed, block_chars)
    return reduce(without, blocks, by_place(docs)).toDF(*docs.columns)
