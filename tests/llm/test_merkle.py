from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillsight.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank string, node string, tree int, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fields(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes, fanout):
    """All levels, from the leaves to the last node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def way(levels, at, fanout):
    for level in levels[:-1]:
        start = at - at % fanout
        yield "".join(level[start:at]), "".join(level[at + 1 : start + fanout])
        at //= fanout


def plain(data, fanout=16):
    held = defaultdict(list)
    for doc_id, source, lang, n_chars, text in data:
        held[source].append((doc_id, sha(fields(doc_id, source, lang, n_chars, text)), (lang, n_chars, text)))
    names = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in names:
        held[source].sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        trees[source] = tree([leaf for _, leaf, _ in held[source]], fanout)
    top = tree([trees[s][-1][0] for s in names], fanout)
    out = []
    for number, source in enumerate(names):
        for at, (doc_id, leaf, (lang, n_chars, text)) in enumerate(held[source]):
            steps = [*way(trees[source], at, fanout), *way(top, number, fanout)]
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                node = sha(fields(doc_id, source, lang, n_chars, lowered(text)))
            for before, after in steps:
                node = sha(before + node + after)
            root = top[-1][0]
            proof = sha("".join(b + a for b, a in steps))
            out.append((doc_id, leaf, trees[source][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame([(*row, "clash", "clash", 1, "clash") for row in data], DOCS)


def found(spark, data):
    docs = frame(spark, data).repartition(7)  # in no order
    return sorted((tuple(r) for r in merkle.verified_documents(docs).collect()), key=repr)


def corpus():
    """Sources around full runs and levels, null ones, single documents, and more sources than a run holds."""
    data = [(i * 7 % 401, "large", "en", i, f"Text Number {i} é") for i in range(400)]
    data += [(5000 + 1000 * n + i, f"of {n}", "en", i, f"T{i}") for n in (15, 16, 17, 256, 257) for i in range(n)]
    data += [(1000 + i, f"src{i}", "de", None, "Ä B") for i in range(40)]
    data += [(2000 + i, None, None, 0, None) for i in range(17)]
    data += [(None, "large", "en", 1, "No Id"), (None, "large", "en", 1, "No Id Either"), (None, None, None, None, "")]
    data += [(5, "ties", "en", 3, t) for t in ("ABC", "abc", "ABC", "abd")]
    return data + [(3000, "", "en", 100_000, "Long " * 20_000), (3001, "Ü", "en", 1, "x"), (3002, "\U0001f600", "en", 1, "x")]


def test_documents_match_plain_trees(spark):
    data = corpus()
    expected = plain(data)
    assert found(spark, data) == expected
    assert any(row[-1] for row in expected) and not all(row[-1] for row in expected)


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_documents(spark, count):
    data = [(i, "s", "en", i, f"T{i}") for i in range(count)]
    assert found(spark, data) == plain(data)


def test_small_runs_and_subroots(spark):
    docs = spark.range(30).select(F.col("id"), (F.col("id") % 4).alias("kind"))
    leaf = merkle.leaf_hash(F.col("id"))
    built = merkle.build(docs, leaf, F.col("kind"), F.col("id"), {"id": F.col("id")}, fanout=3)
    trees = {k: tree([sha(fields(i)) for i in range(30) if i % 4 == k], 3) for k in range(4)}
    root = tree([trees[k][-1][0] for k in range(4)], 3)[-1][0]
    assert sorted(tuple(r) for r in built.subroots.collect()) == [(k, len(trees[k][0]), trees[k][-1][0], root) for k in range(4)]
    again = built.proofs.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count()
    assert again == 30


def test_any_changed_row_changes_the_root(spark):
    data = [(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(9)]
    before = plain(data)[0][3]
    data[4] = (*data[4][:4], data[4][4] + ".")
    assert found(spark, data)[0][3] != before
