"""Merkle manifest of a dataset by lag and lead windows.

The rows of a group (a source) are the leaves of a tree: every ``fanout``
consecutive nodes of a level become their hash in the next one, until one is
left, the group's subroot.  The subroots, in the order of the groups, make a
tree in the same way, whose last node is the root.

1. A leaf's place in its group is a rank over the whole table, found by ranges.
2. A level's siblings are the values of lag and lead at the fixed offsets 1 to
   ``fanout`` - 1, masked by the slot of a node in its run and by the run's
   length.  The windows are partitioned by run, so a group of any size is spread
   over all tasks.  The first child of every run hashes the parent.
3. The way up takes a round for each level, and each level is a sixteenth of the
   one before.  On the way down every node gets its parent's path with its own
   siblings in front, so a leaf ends up with its proof.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import ranked
from .storage import Scratch

FANOUT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def lower_cased(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, _UPPER, _LOWER)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """run, slot and the siblings before and after, of nodes (tree, pos, n, node)."""
    slot = F.col("pos") % fanout
    placed = nodes.withColumns({"run": F.expr(f"pos div {fanout}"), "slot": slot})
    length = F.least(F.lit(fanout), F.col("n") - F.col("pos") + F.col("slot"))
    run = Window.partitionBy("tree", "run").orderBy("pos")
    earlier = [F.when(F.col("slot") >= k, F.lag("node", k).over(run)).otherwise("") for k in range(fanout - 1, 0, -1)]
    later = [F.when(F.col("slot") + k < length, F.lead("node", k).over(run)).otherwise("") for k in range(1, fanout)]
    return placed.withColumns({"before": F.concat(*earlier), "after": F.concat(*later)})


def _levels(nodes: DataFrame, largest: int, fanout: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels of all trees, the leaves first; trees that have ended stay behind."""
    levels = [_with_siblings(nodes, fanout)]
    while largest > 1:
        largest = -(-largest // fanout)
        first_children = levels[-1].where("n > 1 AND slot = 0")
        parents = first_children.select(
            "tree",
            F.col("run").alias("pos"),
            F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            F.sha2(F.concat("node", "after"), 256).alias("node"),
        )
        levels.append(scratch.table(_with_siblings(parents, fanout), f"{name}-{len(levels)}"))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """tree, height and node of the last node of every tree."""
    found = None
    for height, level in enumerate(levels):
        ended = level.where("n = 1").select("tree", F.lit(height).alias("height"), "node")
        found = ended if found is None else found.unionByName(ended)
    return found


def _descended(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves with their path, from that of their tree's last node; ``carried`` columns come along."""
    below = None
    for height in reversed(range(len(levels))):
        above = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("run"), *carried, "path")
        if below is not None:
            above = above.unionByName(below.select("tree", F.col("pos").alias("run"), *carried, "path"))
        step = F.array(F.struct("before", "after"))
        own = F.when(F.col("n") > 1, F.concat(step, F.col("above.path"))).otherwise(F.col("above.path"))
        level = levels[height].alias("level")
        below = level.join(above.alias("above"), ["tree", "run"]).select(
            *[F.col(f"level.{c}") for c in levels[height].columns if c not in ("before", "after")],
            *[F.col(f"above.{c}") for c in carried],
            own.alias("path"),
        )
    return below


@dataclass(frozen=True)
class Manifest:
    """``subroots``: one row per group with its name, number of rows and subroot.

    ``proofs``: one row per leaf with the columns given to ``build``, its subroot,
    the root and path, the siblings before and after it of each level upwards.
    """

    subroots: DataFrame
    proofs: DataFrame


def build(
    rows: DataFrame, leaf: Column, group: Column, order: Column, kept: dict[str, Column], fanout: int = FANOUT, scratch: Scratch | None = None
) -> Manifest:
    """The manifest of ``rows``: leaves of a ``group`` ascend by ``order``, nulls first.

    Rows of one group that are equal in ``order`` ascend by their leaf's hash;
    repeated rows are leaves of their own, whose order makes no difference.
    Groups ascend by their value's UTF-8 bytes, null first.  A table without rows
    has no root, and the frames are empty.  ``kept`` names columns that go along
    with a leaf; nothing else of ``rows`` is looked at, so other columns may have
    any name.
    """
    scratch = scratch or Scratch(rows.sparkSession, "merkle")
    keys = {"_group": group, "_order": order, "node": leaf}
    # Written once, so that texts are read and hashed once.
    hashed = scratch.table(rows.select(*[c.alias(k) for k, c in (keys | {f"kept_{k}": c for k, c in kept.items()}).items()]), "leaves")
    placed = ranked(hashed, ["_group", "_order", "node"], scratch, "ranked")
    groups = placed.groupBy("_group").agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    trees = scratch.table(ranked(groups, ["_group"], scratch, "groups").withColumnRenamed("rank", "tree"), "trees")
    sizes = trees.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count("*").alias("trees")).first()
    own = trees.withColumnRenamed("_group", "_name")
    nodes = placed.join(own, F.col("_group").eqNullSafe(F.col("_name"))).select(
        "tree", (F.col("rank") - F.col("start")).alias("pos"), "n", "node", *[f"kept_{k}" for k in kept]
    )
    levels = _levels(nodes, sizes["largest"], fanout, scratch, "level")
    subroots = scratch.table(_tops(levels), "subroots")

    upper = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sizes["trees"]).alias("n"), "node"
    )
    upper_levels = _levels(upper, sizes["trees"], fanout, scratch, "upper")
    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    root = _tops(upper_levels).select("tree", "height", F.col("node").alias("root"), no_steps.alias("path"))
    above = _descended(upper_levels, root, ["root"]).select(F.col("pos").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    tops = scratch.table(subroots.select("tree", "height").join(above, "tree"), "tops")

    named = tops.select("tree", "subroot", "root").join(own.select("tree", F.col("_name").alias("group"), F.col("n").alias("rows")), "tree")
    proofs = _descended(levels, tops, ["subroot", "root"]).select(
        F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(f"kept_{k}").alias(k) for k in kept]
    )
    return Manifest(named.select("group", "rows", "subroot", "root"), proofs)


def tampers(doc_id: Column, divisor: int = 5) -> Column:
    """Where ``divisor`` divides the unsigned crc32 of the decimal id; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == 0, F.lit(False))


def verified_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every document's leaf and proof, and whether it still leads to the root once some texts are tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    Documents of one source and id ascend by leaf, repeated rows are kept, and
    a text that holds no A-Z survives the tampering, as do null ones.
    """
    texts = F.col("text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    kept = {
        "doc_id": F.col("doc_id"),
        "presented": F.when(tampers(F.col("doc_id")), leaf_hash(*others, lower_cased(texts))),
    }
    proofs = build(docs, leaf_hash(*others, texts), F.col("source"), F.col("doc_id"), kept, scratch=scratch).proofs
    found = proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("presented", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
