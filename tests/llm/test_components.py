from __future__ import annotations

import random

import pytest

from plumbline.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(1, 1), (None, 2), (3, None)],
        [(k, k + 1) for k in range(60)],
        [(0, k) for k in range(1, 80)] + [(200, k) for k in range(201, 230)],
        [(99, k) for k in range(0, 60)],
        [(random.Random(k).randrange(80), random.Random(k + 999).randrange(80)) for k in range(70)],
        [(5, 4), (4, 5), (5, 4), (-7, 5)],
    ],
)
def test_like_union_find(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = components(df).collect()
    assert {r.node: r.component for r in got} == brute(links) and len(got) == len(brute(links))
