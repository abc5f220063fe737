"""Connected components against union-find."""

import random

import pytest

from tidemark.llm.components import components

KIND = "a long, b long"


@pytest.mark.parametrize("case", ["star", "mixed"])
def test_components_match_union_find(spark, case):
    draw = random.Random(3)
    if case == "star":  # one root that meets every node, from both sides of the order
        edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(5001, 5400)] + [(6000 - i, 6000) for i in range(1, 300)]
    else:
        edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (1, 2), (2, 1)]
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, KIND)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == {x: find(x) for x in up}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], KIND)).collect() == []
