"""Language identification by interpolated Kneser-Ney models of characters.

A model per language is counted from labelled texts.  For lookup the models
share sorted arrays of n-gram hashes, one per order, with a column of log
probabilities for each language.  A text goes to the language under which its
cross-entropy per character is lowest; texts that no model explains as well as
it explains texts of its own language are rejected.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .storage import Shared, by_place, small_batches

ORDER = 4
# About so many labelled documents per language are learned from.
TRAIN_DOCS = 1500
# One sampled document in so many sets the scale of the scores and the limits.
CALIBRATE_EVERY = 5
# A text is rejected if its cross-entropy is so many standard deviations above
# the mean of its language, or more where held-out texts of the language lie
# above that; those of the other languages say how far the limit may go.
REJECT_AT = 6.0
# Held-out texts that a language needs for limits of its own.
LEAST_TEXTS = 5
# A share of the language's own texts that is lost weighs so much more than one
# of other texts that is let in.
OWN_WEIGHT = 20.0
# Characters that are looked up at a time.
PIECE = 1 << 20
SPACE = 32
UNDETERMINED = "und"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xFF51AFD7ED558CCD)
OUTPUT = [
    T.StructField("lang_pred", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("accepted", T.BooleanType(), False),
]


def _folded(code: int) -> int:
    """The small form of a letter, or a space."""
    sign = chr(code)
    return ord(sign.lower()[0]) if sign.isalpha() else SPACE


# Code points that most texts consist of.
_FOLDING = np.array([_folded(code) for code in range(0x3000)], dtype=np.uint32)


def _folded_codes(codes: np.ndarray) -> np.ndarray:
    high = codes >= len(_FOLDING)
    out = _FOLDING[np.where(high, SPACE, codes)]
    if high.any():
        found, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_folded(int(code)) for code in found], np.uint32)[at]
    return out


def letters(text: str) -> np.ndarray:
    """Small letters with one space between words, behind the spaces that start a text; empty without a letter."""
    codes = _folded_codes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    blank = codes == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    codes = codes[keep]
    if codes.size and codes[0] == SPACE:
        codes = codes[1:]
    if not codes.size:
        return codes
    end = [] if codes[-1] == SPACE else [SPACE]
    return np.concatenate([np.full(ORDER - 1, SPACE, np.uint32), codes, np.array(end, np.uint32)])


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash for each window of ``order`` characters, by where it ends."""
    wide = codes.astype(np.uint64)
    count = len(wide) - order + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(count, np.uint64)
    for shift in range(order):
        value = (value + wide[shift : shift + count] + np.uint64(1)) * FACTOR
    value ^= value >> np.uint64(29)
    return value * MIXER


def gram_hash(gram: str) -> np.uint64:
    return hashes(np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), np.uint32), len(gram))[0]


@dataclass
class SortedTable:
    """Sorted hashes and a row of values for each."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == wanted


def sorted_table(rows: dict[str, np.ndarray], width: int) -> SortedTable:
    if not rows:
        return SortedTable(np.zeros(0, np.uint64), np.zeros((0, width), np.float32))
    keys = np.array([gram_hash(g) for g in rows], np.uint64)
    order = np.argsort(keys)
    return SortedTable(keys[order], np.array(list(rows.values()), np.float32)[order])


@dataclass
class LanguageModel:
    """The models of all languages, and what their scores mean."""

    languages: list[str]
    probabilities: list[SortedTable]  # by order, from 1
    backoffs: list[SortedTable]  # of contexts, for orders from 2
    unknown: np.ndarray
    sharpness: float = 1.0
    limits: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)
    even: dict[str, float] = field(default_factory=dict)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """One row per character behind the first ORDER - 1, one column per language."""
        return self._of_order(codes, ORDER, np.arange(ORDER - 1, len(codes)))

    def _of_order(self, codes: np.ndarray, order: int, ends: np.ndarray) -> np.ndarray:
        table = self.probabilities[order - 1]
        all_hashes = hashes(codes, order)
        at, known = table.find(all_hashes[ends - (order - 1)])
        out = table.values[at] if len(table.keys) else np.zeros((len(ends), len(self.languages)), np.float32)
        missed = np.flatnonzero(~known)
        if len(missed):
            if order == 1:
                out[missed] = self.unknown
            else:
                lower = self._of_order(codes, order - 1, ends[missed])
                contexts = self.backoffs[order - 2]
                at, known = contexts.find(hashes(codes, order - 1)[ends[missed] - (order - 1)])
                lower[known] += contexts.values[at[known]]
                out[missed] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of every text under every language, its length, and its spread per character."""
        sums = np.zeros((len(texts), len(self.languages)))
        squares = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owners, size
            if not held:
                return
            starts = np.cumsum([0] + [len(h) for h in held[:-1]])
            values = np.zeros((sum(map(len, held)), len(self.languages)), np.float64)
            values[ORDER - 1 :] = self.log_probabilities(np.concatenate(held))
            for start in starts:  # windows that reach into the text before
                values[start : start + ORDER - 1] = 0.0
            np.add.at(sums, owners, np.add.reduceat(values, starts))
            np.add.at(squares, owners, np.add.reduceat(values * values, starts))
            held, owners, size = [], [], 0

        for row, text in enumerate(texts):
            codes = letters(text) if text else np.zeros(0, np.uint32)
            if not codes.size:
                continue
            counts[row] = len(codes) - (ORDER - 1)
            for start in range(0, counts[row], PIECE):
                piece = codes[start : start + PIECE + ORDER - 1]
                if size + len(piece) > PIECE:
                    flush()
                held.append(piece)
                owners.append(row)
                size += len(piece)
        flush()
        n = np.maximum(counts, 1)[:, None]
        mean = -sums / n
        return mean, counts, np.sqrt(np.maximum(squares / n - mean * mean, 0.0))

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        """Shares of the languages, on the fitted scale."""
        power = -self.sharpness * (entropy - entropy.min(axis=1, keepdims=True))
        share = np.exp(power)
        return share / share.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is accepted."""
        if not self.languages:
            nothing = np.zeros(len(texts))
            return [UNDETERMINED] * len(texts), nothing, np.full(len(texts), np.nan), np.zeros(len(texts), bool)
        entropy, counts, _ = self.entropies(texts)
        best = entropy.argmin(axis=1)  # the first by name of equals
        rows = np.arange(len(texts))
        score = np.where(counts > 0, self.scores(entropy)[rows, best], 0.0)
        lowest = np.where(counts > 0, entropy[rows, best], np.nan)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, counts, strict=True)]
        accepted = np.array([n > 0 and self.accepts(name, e, n) for name, e, n in zip(names, lowest, counts)], bool)
        return names, score, lowest, accepted

    def accepts(self, language: str, entropy: float, count: int) -> bool:
        if language not in self.limits:  # no better than letters drawn evenly
            return bool(entropy <= self.even[language])
        mean, spread, per_char, most = self.limits[language]
        return bool(entropy <= mean + most * math.sqrt(spread**2 + per_char**2 / count))


def _limit(own: np.ndarray, other: np.ndarray) -> float:
    """Standard deviations up to which texts are accepted.

    ``own`` are those of the language's texts, ``other`` those of texts of
    other languages.  At least REJECT_AT, so that others near by cost no text of
    the language; above it, the first number with the smallest weighted share of errors.
    """
    tried = np.unique(np.concatenate([own, other, [REJECT_AT]]))
    tried = np.concatenate([tried, (tried[1:] + tried[:-1]) / 2])
    tried = tried[tried >= REJECT_AT]
    missed = 1 - np.searchsorted(np.sort(own), tried, "right") / len(own)
    let_in = np.searchsorted(np.sort(other), tried, "right") / max(1, len(other))
    wrong = OWN_WEIGHT * missed + let_in
    best = tried[wrong <= wrong.min() + 1e-12]
    return float(best.min())


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)


class _Estimate:
    """Interpolated Kneser-Ney of one language from its count tables by order."""

    def __init__(self, tables: dict[int, dict[str, int]]) -> None:
        self.tables = tables
        self.discounts, self.totals, self.types = {}, {}, {}
        for order, table in tables.items():
            self.discounts[order] = _discount(np.fromiter(table.values(), np.int64, len(table)))
            totals: dict[str, int] = defaultdict(int)
            types: dict[str, int] = defaultdict(int)
            for gram, count in table.items():
                totals[gram[:-1]] += count
                types[gram[:-1]] += 1
            self.totals[order], self.types[order] = totals, types
        self.size = len(tables[1]) + 1
        self.memo: dict[str, float] = {}

    def backoff(self, context: str) -> float:
        order = len(context) + 1
        if context not in self.totals[order]:
            return 1.0
        return self.discounts[order] * self.types[order][context] / self.totals[order][context]

    def probability(self, gram: str) -> float:
        if gram in self.memo:
            return self.memo[gram]
        order, context = len(gram), gram[:-1]
        lower = self.probability(gram[1:]) if order > 1 else 1.0 / self.size
        value = self.backoff(context) * lower
        count = self.tables[order].get(gram)
        if count:
            value += max(count - self.discounts[order], 0.0) / self.totals[order][context]
        self.memo[gram] = value
        return value


def build(counts: pd.DataFrame) -> LanguageModel:
    """Models from rows of lang, gram and n, with grams of all orders."""
    languages = sorted(counts["lang"].unique())
    estimates = []
    for language in languages:
        own = counts[counts["lang"] == language]
        tables: dict[int, dict[str, int]] = {k: {} for k in range(1, ORDER + 1)}
        for gram, n in zip(own["gram"], own["n"], strict=True):
            tables[len(gram)][gram] = int(n)
        estimates.append(_Estimate(tables))
    width = len(languages)
    probabilities, backoffs = [], []
    for order in range(1, ORDER + 1):
        grams = sorted(set().union(*(e.tables[order] for e in estimates))) if estimates else []
        probabilities.append(
            sorted_table({g: np.log([e.probability(g) for e in estimates]) for g in grams}, width)
        )
        if order > 1:
            contexts = sorted(set().union(*(e.totals[order] for e in estimates))) if estimates else []
            backoffs.append(sorted_table({h: np.log([e.backoff(h) for e in estimates]) for h in contexts}, width))
    unknown = np.array([math.log(e.backoff("") / e.size) for e in estimates], np.float32)
    even = {name: math.log(e.size) for name, e in zip(languages, estimates, strict=True)}
    return LanguageModel(languages, probabilities, backoffs, unknown, even=even)


def _gram_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the longest grams by language, for each batch."""
    for block in batches:
        for language, texts in block.groupby("lang", sort=False)["text"]:
            found: dict[bytes, int] = defaultdict(int)
            for text in texts:
                codes = letters(text)
                if not codes.size:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                keys, first, n = np.unique(hashes(codes, ORDER), return_index=True, return_counts=True)
                for at, count in zip(first.tolist(), n.tolist(), strict=True):
                    found[windows[at].tobytes()] += count
            yield pd.DataFrame(
                {
                    "lang": language,
                    "gram": [g.decode("utf-32-le", "replace") for g in found],
                    "n": list(found.values()),
                }
            )


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    train_docs: int = TRAIN_DOCS,
) -> LanguageModel:
    """Models of all languages from labelled documents.

    About ``train_docs`` documents of each language are learned from, picked by
    a hash of their key and text, so that the model and its place in memory
    don't grow with the table; in smaller tables all of them are.  Rows without
    text or language are passed over.  An empty table gives a model that
    knows no language.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(key_col, text_col), F.lit(1 << 30)).alias("draw"),
    )
    numbers = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not numbers:
        return build(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    shares = [part for lang, n in numbers.items() for part in (F.lit(lang), F.lit(min(1.0, train_docs / n)))]
    sample = rows.where(F.col("draw") < F.create_map(*shares)[F.col("lang")] * float(1 << 30)).cache()
    # Languages with few documents are learned from all of them and get no limit of their own.
    many = [lang for lang, n in numbers.items() if n >= CALIBRATE_EVERY * LEAST_TEXTS]
    held = (F.col("draw") % CALIBRATE_EVERY == 0) & F.col("lang").isin(*many)
    grams = sample.where(~held).select("lang", "text").mapInPandas(_gram_batches, "lang string, gram string, n long")
    by_order = [grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))]
    for _ in range(ORDER - 1):  # lower orders count the characters that a gram follows
        by_order.append(
            by_order[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        )
    model = build(functools.reduce(DataFrame.union, by_order).toPandas())
    if model.languages:
        _calibrate(model, sample.where(held).select("lang", "text"))
    sample.unpersist()
    return model


def _calibrate(model: LanguageModel, held: DataFrame) -> None:
    """Set the scale of scores and the limits by documents that weren't counted."""
    shared = Shared(held.sparkSession, model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            entropy, counts, spread = shared.value.entropies(block["text"].tolist())
            yield pd.DataFrame(
                {"lang": block["lang"], "entropy": list(entropy), "n": counts, "spread": list(spread)}
            )

    kind = "lang string, entropy array<double>, n long, spread array<double>"
    found = held.mapInPandas(measure, kind).where("n > 0").toPandas()
    shared.destroy()
    found = found[found["lang"].isin(model.languages)]
    if found.empty:
        return
    entropy = np.array(found["entropy"].tolist())
    truth = np.array([model.languages.index(x) for x in found["lang"]])
    rows = np.arange(len(truth))

    def loss(sharpness: float) -> float:
        model.sharpness = sharpness
        return float(-np.log(np.maximum(model.scores(entropy)[rows, truth], 1e-300)).mean())

    model.sharpness = min((2.0**p for p in range(-2, 6)), key=loss)
    counts = found["n"].to_numpy(np.float64)
    spreads = np.array(found["spread"].tolist())
    # The language of each text if the model of its own were left out.
    left = entropy.copy()
    left[rows, truth] = np.inf
    instead = left.argmin(axis=1)
    few = []
    for number, language in enumerate(model.languages):
        own = (truth == number) & (entropy.argmin(axis=1) == number)
        if own.sum() < LEAST_TEXTS:
            few.append((language, number, own))
            continue
        mean, spread, per_char = entropy[own, number].mean(), entropy[own, number].std(), spreads[own, number].mean()
        deviations = (entropy[:, number] - mean) / np.sqrt(spread**2 + per_char**2 / counts)
        other = (truth != number) & (instead == number)
        most = _limit(deviations[own], deviations[other])
        model.limits[language] = (float(mean), float(spread), float(per_char), most)
    # Too few texts give a mean at most; the rest is that of the other languages.
    known = list(model.limits.values())
    for language, number, own in few:
        if own.any() and known:
            spread, per_char = (max(limit[i] for limit in known) for i in (1, 2))
            mean, most = float(entropy[own, number].mean()), min(limit[3] for limit in known)
            model.limits[language] = (mean, spread, per_char, most)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy and accepted.

    Whole texts are read.  A null text, or one without a letter, gives ``und``,
    score 0, no cross-entropy, and isn't accepted; so does every text if the
    model knows no language.  Of languages that fit equally well the first by
    name is taken.  Columns of ``docs`` with the new names are replaced, all
    others are passed on.
    """
    kept = docs.drop(*[f.name for f in OUTPUT])
    shared = Shared(docs.sparkSession, model)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_batches(batches):
            names, score, entropy, accepted = shared.value.predict(block.column(at).to_pylist())
            new = [
                pa.array(names, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(entropy, pa.float64(), from_pandas=True),
                pa.array(accepted, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*block.columns, *new], [*block.schema.names, *(f.name for f in OUTPUT)])

    held = by_place(kept)
    return held.mapInArrow(run, T.StructType([*held.schema.fields, *OUTPUT])).toDF(*kept.columns, *[f.name for f in OUTPUT])


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key as text, modulo ``divisor``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor
