from __future__ import annotations

import random

from scriptorium.operators.components import connected_components


def test_components(spark):
    rng = random.Random(4)
    edges = [("x", i, i + 1) for i in range(1, 40)] + [("y", 1, rng.randrange(2, 300)) for _ in range(200)]
    edges += [("z", rng.randrange(500), rng.randrange(500)) for _ in range(260)] + [("z", 3, 3)]
    frame = spark.createDataFrame(edges, "part string, p long, q long")
    got = {(r["part"], r["node"]): r["component"] for r in connected_components(frame, "part", "p", "q").collect()}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for part, a, b in edges:
        if a != b:
            x, y = find((part, a)), find((part, b))
            parent[max(x, y)] = min(x, y)
    assert got == {v: find(v)[1] for v in parent}
    assert connected_components(frame.limit(0), "part", "p", "q").count() == 0
