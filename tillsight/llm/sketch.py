"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the range of
hashes, so it grows with its text, the sketch of a union is the union of the
sketches, and the share of a short text that a very long one contains can be
told from the two sketches alone.  Of a text none of whose hashes is below the
limit, the smallest is kept, so only texts without words have an empty sketch.

A shingle's hash is a sum of its words' values, each times the multiplier of its
place, modulo a prime; a word's value are the first 32 bits of its MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Scratch

WORDS = 5
# One hash in so many is kept.
SCALE = 16
# The hashes' range, and a multiplier for each place of a shingle.
PRIME = 2**61 - 1
MULTIPLIERS = [pow(7, 1_000_003 * (place + 1), PRIME) for place in range(WORDS)]
# Words whose values a task remembers.
REMEMBERED = 200_000


@dataclass
class Hasher:
    """Sketches of texts, with the values of the words met so far."""

    scale: int = SCALE
    places: dict[bytes, int] = field(default_factory=dict)
    values: np.ndarray = field(default_factory=lambda: np.zeros((WORDS, 1024), np.uint64))

    def _place(self, word: bytes) -> int:
        place = len(self.places)
        if place == self.values.shape[1]:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)], axis=1)
        value = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        self.values[:, place] = [multiplier * value % PRIME for multiplier in MULTIPLIERS]
        self.places[word] = place
        return place

    def sketch(self, text: str) -> np.ndarray:
        """Ascending hashes.  A-Z count as a-z; fewer words than a shingle has are one shingle."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.places) > REMEMBERED:
            self.places, self.values = {}, np.zeros((WORDS, 1024), np.uint64)
        known = self.places
        at = [known[w] if w in known else self._place(w) for w in words]
        at = np.array(at, np.int64)
        length = min(WORDS, len(at))
        count = len(at) - length + 1
        # Five values below 2**61 stay below 2**64.
        total = np.zeros(count, np.uint64)
        for place in range(length):
            total += self.values[place][at[place : place + count]]
        total %= np.uint64(PRIME)
        low = total[total < np.uint64(PRIME // self.scale)]
        return np.unique(low) if len(low) else total.min(keepdims=True)


def packed(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u8").astype(np.uint64)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of the first sketch's hashes that the second holds; 1 of an empty one in an empty one."""
    if not len(one):
        return float(not len(other))
    return float(np.isin(one, other, assume_unique=True).sum()) / len(one)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points give way to the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PASSED = "part int, edge string, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FIELDS = [f.split()[0] for f in _PASSED.split(", ")]
_TYPES = {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _PASSED.split(", ")])


def _finished(hasher: Hasher, part: int, doc_id: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    """The result of a document and the one that follows it."""
    made = edited(text, following)
    sketch = hasher.sketch(made)
    digest = hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest()
    return part, None, doc_id, None, len(text), digest, packed(own), packed(sketch), likeness(own, sketch), likeness(own, its)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _passed(scale: int):
    """From a sorted range (part, doc_id, text): results of all but the last row, and the first and last row as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(scale)
        held: tuple[int, int | None, str, np.ndarray] | None = None
        for block in batches:
            rows = []
            for part, doc_id, text in zip(*(column.to_pylist() for column in block.columns), strict=True):
                sketch = hasher.sketch(text)
                if held is None:
                    rows.append((part, "first", doc_id, text, None, None, packed(sketch), None, None, None))
                else:
                    rows.append(_finished(hasher, *held, text, sketch))
                held = part, doc_id, text, sketch
            yield _batch(rows)
        if held is not None:
            part, doc_id, text, sketch = held
            yield _batch([(part, "last", doc_id, text, None, None, packed(sketch), None, None, None)])

    return run


def _closed(scale: int):
    """Results of the last rows of the ranges, which stand beside the first row of the next range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(scale)
        for block in batches:
            rows = []
            for part, doc_id, text, own, following, its in zip(*(column.to_pylist() for column in block.columns), strict=True):
                rows.append(_finished(hasher, part, doc_id, text, unpacked(own), following, unpacked(its)))
            yield _batch(rows)

    return run


def with_edits(docs: DataFrame, scale: int = SCALE, scratch: Scratch | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16
    hexadecimal digits a hash, ascending), near_edited and near_next: the shares
    of the fingerprint's hashes that the edited text's and the next document's
    hold.  A null text counts as empty; the fingerprint of a text without words
    is empty, and like another empty one only.  Documents ascend by doc_id, null
    first, those of one id by a hash of their text; equal rows follow each other
    and each gives a row.  After the last one comes the first, which of a
    single document is itself.  An empty table gives an empty result; other
    columns are ignored.

    The texts are dealt to ranges of ids, so that every document meets its
    successor; only the rows at the ranges' ends are joined.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sketch")
    order = ["doc_id", "_tie", "_salt"]
    text = F.coalesce(F.col("text"), F.lit(""))
    ranges = (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"))
        .withColumns({"_tie": F.xxhash64("text"), "_salt": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    passed = ranges.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_passed(scale), _PASSED)
    stored = scratch.table(passed, "passed")

    firsts, lasts = (stored.where(F.col("edge") == e) for e in ("first", "last"))
    # One row for each range: the number of the next one that holds rows.
    parts = firsts.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), parts.agg(F.min("part")).scalar())
    ends = (
        lasts.select("part", "doc_id", "text", "fingerprint")
        .join(parts.select("part", following.alias("next")), "part")
        .join(firsts.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("its")), "next")
        .select("part", "doc_id", "text", "fingerprint", "next_text", "its")
        .mapInArrow(_closed(scale), _PASSED)
    )
    return stored.where("edge IS NULL").unionByName(ends).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def fingerprints(docs: DataFrame, *kept: str, scale: int = SCALE) -> DataFrame:
    """The columns ``kept`` and ``fingerprint`` of every document."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*kept).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(scale)
        for block in batches:
            texts = block.column(block.num_columns - 1).to_pylist()
            made = pa.array([packed(hasher.sketch(t or "")).hex() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], made], [*kept, "fingerprint"])

    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in kinds.items()), "fingerprint string"])
    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


def hashes(fingerprint: Column) -> Column:
    """The array of a fingerprint's hashes, each as its 16 digits."""
    return F.when(fingerprint == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(fingerprint) - 15, F.lit(16)), lambda at: F.substring(fingerprint, at, F.lit(16)))
    )


def merged(prints: DataFrame, *by: str) -> DataFrame:
    """The sketch of all texts of a group, a row for each hash: the columns ``by`` and ``hash``."""
    return prints.select(*by, F.explode(hashes(F.col("fingerprint"))).alias("hash")).distinct()


def contained(prints: DataFrame, id_col: str, sketch: DataFrame) -> DataFrame:
    """The share of each document that a merged sketch (``hash``) holds: id, hashes, held and share.

    Documents without words are left out.
    """
    own = prints.select(id_col, F.explode(hashes(F.col("fingerprint"))).alias("hash"))
    marked = own.join(sketch.select("hash", F.lit(1).alias("in")).distinct(), "hash", "left")
    counted = marked.groupBy(id_col).agg(F.count("*").alias("hashes"), F.count("in").alias("held"))
    return counted.withColumn("share", F.col("held") / F.col("hashes"))
