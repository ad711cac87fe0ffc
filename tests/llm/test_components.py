from __future__ import annotations

import random

from helpers import rows

from tillsight.llm.components import components
from tillsight.llm.storage import Scratch


def test_components_of_paths_stars_and_rings(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    names = {n: n for e in edges for n in e}
    draw.shuffle(edges)
    found = rows(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c"), "node", "component")
    start = {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert dict(found) == {n: start[n] for n in names if n in start}
    assert len(found) == len(start)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").collect() == []
