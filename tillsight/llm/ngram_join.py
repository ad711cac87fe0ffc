"""N-gram Jaccard self-join with a token-group matrix.

1. Every document becomes its set of hashed word n-grams; equal sets are one
   node from then on.
2. Two linked sets of n and m tokens differ by at most (1 - t) / (1 + t) (n + m)
   tokens.  If the tokens are dealt to more buckets than that, at least one
   bucket is equal.  Each set signs its buckets that aren't empty, of which one
   is equal as well if there are some buckets more; sets that share a signature
   are a block.  Bands of sizes fix the number of buckets, and a set signs
   for its own band and for the next.  Within a block those pairs are tied whose
   outlines, counts of tokens by pattern, leave a link possible.
3. Where such ties hold sets together, fine outlines, with a count for every few
   tokens, are compared in their place, and only what they leave possible is still
   tied.  They take a fraction of the room that the sets take.
4. Sets that are still held together are partitioned into groups of similar sets
   with the union of each group's tokens.  A set's overlap with the union is an
   upper bound of its overlap with any member; only groups whose bound reaches
   what a link needs are opened and their members compared exactly.
5. Links make components.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .components import components
from .storage import Scratch, Shared, by_place, small_batches

WORDS, NUMERATOR, DENOMINATOR = 3, 90, 100
# Tokens that a task holds of each side of a comparison.
CHUNK_TOKENS = 1_000_000
# Bits, and the parts of a hash that pick them, of the filter of candidates' ids.
FILTER_BITS, FILTER_TURNS = 26, (0, 19, 38)
GROUP_SETS = 24
# Times that a set with many empty buckets deals its tokens, at most.
TURNS = 6
# Counts in the outline of a set, and sets of a block that a task holds.
OUTLINE, LARGEST_BLOCK = 128, 4096
# Tokens for each count of a fine outline, and bytes of them that a task holds of
# each side of a comparison.
FINE_TOKENS, CHUNK_BYTES = 8, 8_000_000
# Sets that a task remembers to sign equal ones only once.
REMEMBERED = 200_000
# Signatures, or those of 512 sets, that leave a task at a time.
BATCH_ROWS = 65_536
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(33))) * P3
    value = (value ^ (value >> np.uint64(29))) * P2
    return value ^ (value >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words.

    Words are runs of other characters than space and the five ASCII control
    characters from tab on; A-Z count as a-z.  Fewer words make one run.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, found), np.uint64, len(found))
    length = min(words, len(each))
    count = len(each) - length + 1
    value = np.full(count, length, np.uint64)
    for shift in range(length):
        value = _mix(value * P1 + each[shift : shift + count])
    return np.unique(value)


@dataclass(frozen=True)
class Threshold:
    """Sets link when den * |intersection| >= num * |union|."""

    num: int = NUMERATOR
    den: int = DENOMINATOR

    def difference(self, total: int) -> int:
        """The most tokens by which two linked sets of ``total`` tokens differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def least_size(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def needed(self, total):
        """The least overlap of two linked sets of ``total`` tokens."""
        return -(-self.num * total // (self.num + self.den))

    def band(self, n: int) -> tuple[int, int, int]:
        """Number of the band of sizes that holds ``n``, its last size, and that of the next band."""
        low, number = 1, 0
        while True:
            high = max(low, low * self.den // self.num)
            if n <= high:
                return number, high, max(high + 1, (high + 1) * self.den // self.num)
            low, number = high + 1, number + 1

    def links(self, overlap, total):
        return self.den * overlap >= self.num * (total - overlap)


def _spare(differ: int, least: int) -> tuple[int, bool]:
    """Buckets beyond those that may differ and one more, and whether sets rarely leave more of them empty.

    ``least`` is the size of the smallest set that signs.  The number has room for
    two standard deviations of its empty buckets, or for their mean at least; where
    buckets outnumber the tokens there is none.  Sums and products alone give
    the same number on every machine.
    """

    def empty(spare: int, deviations: int) -> float:
        buckets = differ + 1 + spare
        load, term, whole = least / buckets, 1.0, 1.0
        for turn in range(1, 20):
            term *= load / turn
            whole += term
        share = 1 / whole
        spread = max(0.0, share - (1 + load) * share * share)
        return buckets * share + deviations * math.sqrt(buckets * spread)

    for deviations in (2, 0):
        low, high = 0, differ + 2
        while low < high:
            middle = (low + high) // 2
            if empty(middle, deviations) <= middle:
                high = middle
            else:
                low = middle + 1
        if empty(low, deviations) <= low:
            return low, True
    return (2 if differ >= 8 else 1 if differ >= 3 else 0), False


# What a worker has worked out so far, a few numbers for each band.
_spares: dict[tuple[int, int], tuple[int, bool]] = {}


def signatures(tokens: np.ndarray, threshold: Threshold) -> np.ndarray:
    """What a set signs in its own band and in the next.

    Empty buckets aren't signed, as they tie unrelated sets, more of them the
    more sets there are.  With ``spare`` buckets more than needed ``spare + 1`` are
    equal, so one that isn't empty is equal if either set leaves at most ``spare``
    empty.  A set that leaves more deals its tokens anew and signs those buckets
    as well, and so does any set that it could miss.  Only what is left after the
    last turn signs its empty buckets too.  A band whose sets may not differ signs
    nothing: equal sets are one already.
    """
    number, high, next_high = threshold.band(len(tokens))
    low_half = (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high_half = (tokens >> np.uint64(32)).astype(np.float64)
    out = []
    for band, last in ((number, high), (number + 1, next_high)):
        differ = threshold.difference(2 * last)
        if not differ:
            continue
        # The smallest set that can be linked to one of the band.
        least = threshold.least_size(threshold.least_size(last))
        if (differ, least) not in _spares:
            _spares[differ, least] = _spare(differ, least)
        spare, rarely = _spares[differ, least]
        buckets = differ + 1 + spare
        turns = TURNS if rarely else 1
        for turn in range(turns):
            dealt = _mix(tokens + np.uint64(turn * int(P1) & 0xFFFFFFFFFFFFFFFF)) if turn else tokens
            at = (dealt % np.uint64(buckets)).astype(np.int64)
            # Sums of halves stay below 2**53 and are exact in doubles.
            low = np.bincount(at, low_half, buckets).astype(np.uint64)
            top = np.bincount(at, high_half, buckets).astype(np.uint64)
            label = np.arange(buckets, dtype=np.uint64) + np.uint64((turn << 56) + (band << 32))
            signed = _mix(_mix(low * P1 + label) + top)
            full = np.bincount(at, minlength=buckets) > 0
            enough = (~full).sum() <= spare
            out.append(signed[full] if enough or turn + 1 < turns else signed)
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _fingerprint(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size, fingerprint and outline of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_batches(batches):
            sets = [shingles(text, words) for text in block.column(1).to_pylist()]
            sizes = pa.array([len(tokens) for tokens in sets], pa.int64())
            prints = pa.array([_fingerprint(tokens) for tokens in sets], pa.binary())
            outlines = pa.array([_outline(tokens) for tokens in sets], pa.binary())
            columns = [block.column(0), sizes, prints, outlines]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "print", "outline"])

    return docs.mapInArrow(run, "doc_id long, n long, print binary, outline binary")


def _signed(docs: DataFrame, words: int, threshold: Threshold) -> DataFrame:
    """mark and node: the signatures of every set that is new to the task.

    The sets are made anew rather than stored with the profiles, as signatures
    take more room than the texts.  Equal sets sign once per task, so a text
    that many documents share adds no more rows than there are tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        marks: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(part).view(np.int64)) for part in (marks, nodes)]
            marks.clear()
            nodes.clear()
            return pa.RecordBatch.from_arrays(columns, ["mark", "node"])

        for block in small_batches(batches):
            for text in block.column(0).to_pylist():
                tokens = shingles(text, words)
                mark = _fingerprint(tokens)
                if mark is None or mark in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(mark)
                marks.append(signatures(tokens, threshold))
                nodes.append(np.full(len(marks[-1]), xxhash.xxh3_64_intdigest(mark), np.uint64))
                if sum(map(len, marks)) >= BATCH_ROWS or len(marks) >= 512:
                    yield batch()
        if marks:
            yield batch()

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "mark long, node long")


def _numbered(prints: DataFrame) -> DataFrame:
    """The sets with the number that stands for them while candidates are looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            number = [xxhash.xxh3_64_intdigest(mark) for mark in block.column(0).to_pylist()]
            made = pa.array(np.array(number, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*block.columns, made], [*block.schema.names, "number"])

    return prints.mapInArrow(run, "print binary, first_doc long, copies long, n long, outline binary, number long")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by signature and set: those whose signature several sets share, once each."""
    held: tuple[int, int, bool] | None = None  # the last row, and whether it is already known to share
    for block in batches:
        mark, node = block["mark"].to_numpy(), block["node"].to_numpy()
        if not len(mark):
            continue
        if held is not None:
            mark, node = np.concatenate([[held[0]], mark]), np.concatenate([[held[1]], node])
        fresh = np.ones(len(mark), bool)
        fresh[1:] = (mark[1:] != mark[:-1]) | (node[1:] != node[:-1])
        mark, node = mark[fresh], node[fresh]
        same = mark[1:] == mark[:-1]
        shared = np.zeros(len(mark), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= held is not None and held[2]
        held = (int(mark[-1]), int(node[-1]), bool(shared[-1]))
        if shared[:-1].any():
            yield pd.DataFrame({"mark": mark[:-1][shared[:-1]], "node": node[:-1][shared[:-1]]})
    if held is not None and held[2]:
        yield pd.DataFrame({"mark": [held[0]], "node": [held[1]]})


def _outline(tokens: np.ndarray) -> bytes:
    """How many tokens of a set start with each of 128 bit patterns; 255 means that many or more."""
    counts = np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=OUTLINE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _shared_at_most(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of sets by their outlines: the smaller count of each pattern."""
    smaller = np.minimum(one, other)
    unknown = (smaller == 255).any(axis=1)  # not counted beyond, so no bound
    return np.where(unknown, 1 << 40, smaller.sum(axis=1, dtype=np.int64))


def _tied(outlines: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """A forest over the sets of a block that ties all pairs whose outlines leave a link possible."""
    edges = []
    left = np.arange(len(sizes))
    while len(left) > 1:
        near, left = [int(left[0])], left[1:]
        while near and len(left):
            i = near.pop()
            bound = _shared_at_most(outlines[left], outlines[i])
            reached = bound >= threshold.needed(sizes[left] + sizes[i])
            found = left[reached].tolist()
            edges.extend((other, i) for other in found)
            near += found
            left = left[~reached]
    return edges


def _forests(threshold: Threshold):
    """From rows sorted by signature: edges that tie what may link within each block.

    A block beyond ``LARGEST_BLOCK`` sets isn't held; its sets are all tied to
    the first, which only adds comparisons later.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        whole: int | None = None  # the signature of a block that is tied to its first set
        for block in batches:
            if held is not None:
                block = pd.concat([held, block], ignore_index=True)
            if block.empty:
                continue
            mark = block["mark"].to_numpy()
            end = int(np.flatnonzero(mark == mark[-1])[0])
            rest = block.iloc[:end][mark[:end] == whole]
            if len(rest) > 1:
                yield pd.DataFrame({"a": rest["node"].to_numpy()[1:], "b": rest["node"].iloc[0]})
            yield from finished(block.iloc[:end], whole)
            held = block.iloc[end:]
            if len(held) > LARGEST_BLOCK or (whole is not None and whole == mark[-1]):
                whole = mark[-1]
                yield pd.DataFrame({"a": held["node"].to_numpy()[1:], "b": held["node"].iloc[0]})
                held = held.iloc[:1]
        if held is not None:
            yield from finished(held, whole)

    def finished(rows: pd.DataFrame, whole: int | None) -> Iterator[pd.DataFrame]:
        rows = rows[rows["mark"] != whole] if whole is not None else rows
        if len(rows) < 2:
            return
        mark, node, sizes = rows["mark"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy()
        outlines = np.frombuffer(b"".join(rows["outline"]), np.uint8).reshape(len(rows), OUTLINE)
        starts = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(rows)]]))
        first = starts[lengths == 2]
        bound = _shared_at_most(outlines[first], outlines[first + 1])
        first = first[bound >= threshold.needed(sizes[first] + sizes[first + 1])]
        a, b = [node[first + 1]], [node[first]]
        for start, length in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            part = slice(start, start + length)
            edges = _tied(outlines[part], sizes[part], threshold)
            a.append(node[part][[i for i, _ in edges]] if edges else node[:0])
            b.append(node[part][[j for _, j in edges]] if edges else node[:0])
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


@dataclass
class IdFilter:
    """A Bloom filter over hashes of ids: passes all that were put in, and few others."""

    words: np.ndarray
    shift: int

    def holds(self, draws: np.ndarray) -> np.ndarray:
        out = np.ones(len(draws), bool)
        for turn in FILTER_TURNS:
            at = (draws.view(np.uint64) >> np.uint64(turn)) & np.uint64((1 << self.shift) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _filter_of(ids: DataFrame) -> IdFilter:
    """The filter has 2**FILTER_BITS bits at most; beyond its room it passes more, never less."""
    shift = min(FILTER_BITS, max(10, (16 * ids.count()).bit_length()))
    draw = F.xxhash64(ids.columns[0])
    places = F.array(*[F.shiftrightunsigned(draw, turn).bitwiseAND(F.lit((1 << shift) - 1)) for turn in FILTER_TURNS])
    place = ids.select(F.explode(places).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (shift - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return IdFilter(out, shift)


def _fine_outline(tokens: np.ndarray) -> bytes:
    """How many tokens of a set start with each bit pattern; 255 means that many or more.

    The number of patterns is a power of 2 and grows with the set.
    """
    bits = max(7, (len(tokens) // FINE_TOKENS).bit_length())
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _coarser(outline: np.ndarray, patterns: int) -> np.ndarray:
    """An outline with fewer patterns; a count that isn't known stays unknown."""
    parts = outline.reshape(patterns, -1).astype(np.int64)
    return np.where((parts == 255).any(axis=1), 255, np.minimum(parts.sum(axis=1), 254)) if parts.shape[1] > 1 else outline


def _finely_tied(threshold: Threshold):
    """A forest over the sets of one cell that ties all pairs whose fine outlines leave a link possible."""

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        _, first, second = key
        edges: list[tuple[int, int]] = []
        for _, part in cell.groupby("group", sort=False):
            part = part.drop_duplicates("node").sort_values("n", kind="stable")
            sizes, nodes = part["n"].to_numpy(), part["node"].to_numpy()
            side = part["chunk"].to_numpy()
            outlines = [np.frombuffer(o, np.uint8) for o in part["packed"]]
            # Sets of one length stand in one matrix, at most one step finer than asked for.
            patterns = np.array([len(o) for o in outlines])
            rows = {p: np.flatnonzero(patterns == p) for p in np.unique(patterns)}
            stacked = {p: np.stack([outlines[i] for i in at]) for p, at in rows.items()}
            label = np.arange(len(sizes))
            for i in range(1, len(sizes)):
                low = np.searchsorted(sizes, threshold.least_size(int(sizes[i])))
                for p, at in rows.items():
                    if p > patterns[i]:
                        continue
                    near = at[(at >= low) & (at < i)]
                    near = near[label[near] != label[i]]
                    if first != second:
                        near = near[side[near] != side[i]]
                    if not len(near):
                        continue
                    own = _coarser(outlines[i], p)
                    bound = _shared_at_most(stacked[p][np.searchsorted(at, near)], own)
                    for other in near[bound >= threshold.needed(sizes[near] + sizes[i])]:
                        if label[other] != label[i]:
                            edges.append((int(nodes[i]), int(nodes[other])))
                            label[label == label[other]] = label[i]
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


class _Index:
    """Sorted tokens with the number of the set that each belongs to."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.count = tokens[order], owner[order], len(sets)

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """Number of common tokens with each set."""
        low = np.searchsorted(self.tokens, tokens, "left")
        size = np.searchsorted(self.tokens, tokens, "right") - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=self.count)


def linked_pairs(
    sets: list[np.ndarray], threshold: Threshold, side: np.ndarray | None = None, group_sets: int = GROUP_SETS
) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the earlier ones that it links to, each pair once.

    With ``side``, only pairs of sets from different sides are looked at.
    """
    sizes = np.array([len(s) for s in sets])
    # Near copies mostly share their smallest hash, so they become neighbours.
    order = np.lexsort((sizes, [s[0] for s in sets]))
    groups = [order[start : start + group_sets] for start in range(0, len(order), group_sets)]
    matrix = _Index([np.unique(np.concatenate([sets[m] for m in group])) for group in groups])
    smallest = np.array([sizes[g].min() for g in groups])
    largest = np.array([sizes[g].max() for g in groups])
    place = np.empty(len(sets), np.int64)
    place[order] = np.arange(len(order))
    opened: dict[int, _Index] = {}
    for query in order:
        n = int(sizes[query])
        low = threshold.least_size(n)
        bound = matrix.overlaps(sets[query])
        could = (bound >= threshold.needed(n + np.maximum(smallest, low))) & (largest >= low)
        could &= (threshold.num * smallest <= threshold.den * n) & (np.arange(len(groups)) <= place[query] // group_sets)
        found = []
        for number in np.flatnonzero(could):
            group = groups[number]
            if number not in opened:
                opened[number] = _Index([sets[m] for m in group])
            overlap = opened[number].overlaps(sets[query])
            ok = threshold.links(overlap, sizes[group] + n) & (place[group] < place[query])
            if side is not None:
                ok &= side[group] != side[query]
            found.append(group[ok])
        if found:
            yield int(query), np.concatenate(found)


def _verified(threshold: Threshold):
    """Compares the candidates of one cell; a forest of their links and the links' numbers."""

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        _, first, second = key
        for _, part in cell.groupby("group", sort=False):
            part = part.drop_duplicates("node")
            sets = [np.frombuffer(t, np.uint64) for t in part["packed"]]
            nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            side = None if first == second else part["chunk"].to_numpy()
            parent = list(range(len(sets)))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links = np.zeros(len(sets), np.int64)
            for query, others in linked_pairs(sets, threshold, side):
                links[query] += copies[others].sum()
                links[others] += copies[query]
                for other in others:
                    a, b = root(query), root(int(other))
                    if a != b:
                        parent[a] = b
            out.extend((int(nodes[i]), int(nodes[root(i)]), int(links[i])) for i in np.flatnonzero(links))
        return pd.DataFrame(out, columns=["node", "tied", "links"])

    return run


def _packed(texts: DataFrame, candidates: DataFrame, words: int, pack) -> DataFrame:
    """doc_id, print and what ``pack`` makes of the set, of the documents that may stand for candidates.

    Few documents are candidates: only their sets are made and go into a join.
    """
    wanted = Shared(texts.sparkSession, _filter_of(candidates.select("first_doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_batches(batches):
            some = block.filter(pa.array(wanted.value.holds(block.column(2).to_numpy()), pa.bool_()))
            sets = [shingles(text, words) for text in some.column(1).to_pylist()]
            prints = pa.array([_fingerprint(tokens) for tokens in sets], pa.binary())
            made = pa.array([pack(tokens) for tokens in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), prints, made], ["doc_id", "print", "packed"])

    return (
        texts.where("doc_id IS NOT NULL")
        .withColumn("draw", F.xxhash64("doc_id"))
        .mapInArrow(run, "doc_id long, print binary, packed binary")
    )


def _grid(candidates: DataFrame, size, chunk: int, packed: DataFrame) -> DataFrame:
    """The candidates' sets as the cells (task, first, second) of their comparisons.

    Groups of up to ``chunk`` share tasks; larger ones are cut into chunks, and
    each pair of chunks is a cell of its own, in which ``second`` is one more than
    the second chunk.
    """
    sized = candidates.withColumn("size", size)
    groups = sized.groupBy("group").agg(F.sum("size").alias("size"))
    shared = max(1, -(-int(groups.agg(F.sum("size")).first()[0] or 0) // chunk))
    groups = groups.select("group", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    placed = candidates.join(groups, "group").select(
        F.col("first_doc").alias("doc_id"),
        "node",
        "group",
        "copies",
        "n",
        "print",
        F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int").alias("chunk"),
        "chunks",
    )
    # Another text of the same id is another set.
    held = packed.join(placed, ["doc_id", "print"])
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return spread.select(
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("group"), F.lit(shared))).otherwise(F.col("group")).alias("task"),
        F.least("chunk", "other").alias("first"),
        # Tasks of small groups and of large ones never meet.
        F.when(F.col("chunks") == 1, 0).otherwise(F.greatest("chunk", "other") + 1).alias("second"),
        "group",
        "node",
        "copies",
        "n",
        "chunk",
        "packed",
    )


def _in_cell(compare):
    """``compare`` with a cell's key: task, first and second chunk, the same twice for small groups."""

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        task, first, second = key
        return compare((task, first, first if second == 0 else second - 1), cell)

    return run


def _profiled(docs: DataFrame, words: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id and text of all rows, and their profiles."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts, scratch.table(_profiles(texts, words), "profiles")


def _linked_sets(
    texts: DataFrame, profiles: DataFrame, words: int, threshold: Threshold, chunk_tokens: int, scratch: Scratch
) -> DataFrame:
    """Every set of a row with an id: print, first_doc, copies, component and links.

    ``component`` is the first document, and of several sets of that one the first
    fingerprint, of the sets that links lead to.
    """
    sets = (
        profiles.where("print IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("print")
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("outline").alias("outline"))
    )
    sets = scratch.table(_numbered(sets).withColumn("node", F.monotonically_increasing_id()), "sets")

    signed = _signed(texts, words, threshold)
    members = signed.repartition("mark").sortWithinPartitions("mark", "node").mapInPandas(_members, "mark long, node long")
    outlined = members.join(sets.select(F.col("number").alias("node"), "n", "outline"), "node")
    ties = outlined.repartition("mark").sortWithinPartitions("mark", "node").mapInPandas(
        _forests(threshold), "a long, b long"
    )
    hanging = components(ties, scratch, "candidates").withColumnRenamed("node", "number")
    kept = ("node", "first_doc", "print", "copies", "n")
    candidates = hanging.join(sets, "number").select(F.col("component").alias("group"), *kept)
    candidates = scratch.table(candidates, "candidates-coarse")

    bytes_of = F.greatest(F.lit(OUTLINE), F.col("n") * 2 / FINE_TOKENS)
    cells = _grid(candidates, bytes_of, CHUNK_BYTES, _packed(texts, candidates, words, _fine_outline))
    finer = cells.groupBy("task", "first", "second").applyInPandas(_in_cell(_finely_tied(threshold)), "a long, b long")
    closer = components(finer, scratch, "closer")
    candidates = closer.join(candidates.drop("group"), "node").select(F.col("component").alias("group"), *kept)
    candidates = scratch.table(candidates, "groups")
    scratch.drop("candidates-coarse")

    cells = _grid(candidates, F.col("n"), chunk_tokens, _packed(texts, candidates, words, np.ndarray.tobytes))
    found = cells.groupBy("task", "first", "second").applyInPandas(
        _in_cell(_verified(threshold)), "node long, tied long, links long"
    )
    found = scratch.table(found, "links")
    scratch.drop("groups")
    joined = components(found.select(F.col("node").alias("a"), F.col("tied").alias("b")), scratch, "linked")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = sets.select("node", "print", "first_doc", "copies").join(joined, "node", "left").join(counts, "node", "left")
    whole = F.coalesce("component", "node")
    firsts = grouped.groupBy(whole.alias("whole")).agg(F.min(F.struct("first_doc", "print")).alias("first"))
    return grouped.withColumn("whole", whole).join(firsts, "whole").select(
        "print",
        F.col("first.first_doc").alias("component_id"),
        F.col("first.print").alias("component_print"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def join(
    docs: DataFrame,
    words: int = WORDS,
    threshold: Threshold = Threshold(),
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Every document with its component: doc_id, n_shingles, component_id, n_links.

    ``component_id`` is the smallest id that links lead to, ``n_links`` the
    number of other documents a document links to directly, equal ones
    included.  A document without words has no tokens, no links and its own id.
    A row without an id gets the component of the documents with the same
    tokens (null if there is none) and counts as no document.  Rows that share
    an id are documents of their own, and may belong to different components.
    Other columns are ignored; an empty table gives an empty result.

    A task compares at most about ``chunk_tokens`` tokens with as many others:
    candidates that hang together beyond that are dealt to chunks, and every
    pair of chunks is a task of its own.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    texts, profiles = _profiled(docs, words, id_col, text_col, scratch)
    of_sets = _linked_sets(texts, profiles, words, threshold, chunk_tokens, scratch).drop("component_print")
    return profiles.select("doc_id", "n", "print").join(of_sets, "print", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, words: int = 5, threshold: Threshold = Threshold(80, 100), scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id.

    Different texts of one id are different documents.  Of rows with the same id
    and the same tokens one stays, that with the smallest text; rows without an id
    stay, and so do those without words, but for repeated ones of an id.  Only
    rows that go, or whose id is repeated, meet in a shuffle.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    texts, profiles = _profiled(docs, words, "doc_id", "text", scratch)
    of_sets = _linked_sets(texts, profiles, words, threshold, CHUNK_TOKENS, scratch)
    stays = F.col("print").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("print") == F.col("component_print")))
    found = profiles.where("doc_id IS NOT NULL").select("doc_id", "print").join(of_sets, "print", "left")
    found = scratch.table(found.select("doc_id", "print", stays.alias("stays")), "found")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.every("stays").alias("stays"))
    doubtful = scratch.table(ids.where("rows > 1 OR NOT stays").select("doc_id"), "doubtful")
    wanted = Shared(docs.sparkSession, _filter_of(doubtful))
    held = by_place(docs)
    at = docs.columns.index("text")
    own_id, own_text = f"c{docs.columns.index('doc_id')}", f"c{at}"

    def part(inside: bool, made: T.StructType) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in small_batches(batches):
                passed = wanted.value.holds(block.column(block.num_columns - 1).to_numpy())
                some = block.filter(pa.array(passed if inside else ~passed, pa.bool_()))
                columns, names = some.columns[:-1], some.schema.names[:-1]
                if inside:
                    prints = [_fingerprint(shingles(text, words)) for text in some.column(at).to_pylist()]
                    columns, names = [*columns, pa.array(prints, pa.binary())], [*names, "print"]
                yield pa.RecordBatch.from_arrays(columns, names)

        named = held.where(F.col(own_id).isNotNull()).withColumn("draw", F.xxhash64(F.col(own_id).cast("long")))
        return named.mapInArrow(run, made)

    marked = part(True, T.StructType([*held.schema.fields, T.StructField("print", T.BinaryType())]))
    gone = found.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).distinct()
    left = marked.join(gone, (F.col(own_id) == F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left_anti")
    first = Window.partitionBy(own_id, "print").orderBy(own_text)
    kept = left.withColumn("place", F.row_number().over(first)).where("place = 1").select(*held.columns)
    whole = part(False, held.schema).unionByName(kept).unionByName(held.where(F.col(own_id).isNull()))
    return whole.toDF(*docs.columns)
