from __future__ import annotations

import numpy as np

from scriptorium.llm import neighbours as N

SCHEMA = "vec_row long, embedding array<float>, metadata struct<deduplicated:boolean>, cell int"


def pairs_of(ids, x, least=0.9, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -2)
    out = set()
    for r in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[r, j], ids[j]))[:k]:
            if s[r, j] >= least:
                out.add(tuple(sorted((ids[r], ids[j]))))
    return out


def test_quantiles():
    for p, dims, value in ((0.95, 8, 15.507), (0.5, 8, 7.344), (0.99, 4, 13.277)):
        assert abs(N.chi_square_quantile(p, dims) - value) < 0.01


def test_more_rows_need_more_trees():
    assert N.trees_needed(500) == 1 < N.trees_needed(100_000) < N.trees_needed(10_000_000) < N.trees_needed(10**9)


def test_search_stops_and_finds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 128)).astype(np.float32)
    x[350:] = x[:350] + 0.2 * rng.standard_normal((350, 128))
    unit = N._unit(x)
    quantile = N.chi_square_quantile(1 - N.MISS_PROBABILITY, N.DIMS)
    a, b, cosine = N.search_incrementally(unit, unit @ N.projection(0), quantile, 0.9, 5)
    met = set(zip(a.tolist(), b.tolist()))
    assert np.allclose(cosine, (unit[a] * unit[b]).sum(1), atol=1e-5) and len(met) == len(a)
    assert sum((i, i + 350) in met and (i + 350, i) in met for i in range(350)) >= 345
    for n in (1, 2, 33):
        assert len(N.search_incrementally(unit[:n], (unit @ N.projection(0))[:n], quantile, -1.0, 5)[0]) == n * (n - 1)


def test_cells_are_balanced():
    points = np.random.default_rng(1).standard_normal((4000, 8)).astype(np.float32)
    cells = N.cells_of(points, *N.fit_cells(points, 4))
    assert np.bincount(cells, minlength=16).min() > 200


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((2500, 128))
    near = base[:400] + rng.standard_normal((400, 128)) * rng.uniform(0.05, 0.45, (400, 1))
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), (False,), 3) for i, v in enumerate(x)]
    extra = [(9000, None, (False,), 3), (9001, [0.0] * 128, (False,), 3), (9002, [1.0] * 64, (False,), 3), (9003, x[0].tolist(), (True,), 3), (9004, x[0].tolist(), None, 3)]
    frame = spark.createDataFrame(rows + extra, SCHEMA)
    truth = pairs_of(list(range(len(x))), x.astype(np.float64))
    found = {(r["vec_a"], r["vec_b"]) for r in N.find_pairs(frame).collect()}
    assert found <= truth and len(found) >= 0.97 * len(truth) > 100
    leaves = {(r["vec_a"], r["vec_b"]) for r in N.find_pairs(frame, leaf=128).collect()}  # about 32 leaves a tree
    assert leaves <= truth and len(leaves) >= 0.97 * len(truth)
    assert N.find_pairs(frame.limit(0)).count() == 0
    asked = frame.where("vec_row % 100 = 0 and vec_row < 9000").selectExpr("vec_row as query_id", "embedding")
    assert N.exact_neighbours(frame, asked).where("rank = 1 and query_id = id").count() == asked.count()


def test_classes_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(128)
    x = np.array([one] * 9 + [one * 2 + rng.standard_normal(128) * 0.1] + list(rng.standard_normal((30, 128)))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), (False,), 0) for i, v in enumerate(x)], SCHEMA)
    found = {(r["vec_a"], r["vec_b"]) for r in N.find_pairs(frame).collect()}
    first = {tuple(sorted((a, b))) for a in range(9) for b in [v for v in range(7) if v != a][:5]}
    assert found == first | {(b, 9) for b in range(5)}


def test_dense_cluster_keeps_the_true_nearest(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(128)
    x = np.concatenate([centre + rng.standard_normal((200, 128)) * 0.003, rng.standard_normal((50, 128))]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), (False,), 0) for i, v in enumerate(x)], SCHEMA)
    truth = pairs_of(list(range(len(x))), x.astype(np.float64))
    assert {(r["vec_a"], r["vec_b"]) for r in N.find_pairs(frame).collect()} == truth
