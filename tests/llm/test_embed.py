"""Embedding links against all pairs: exact links, measured recall."""

import math

import numpy as np
import pytest

from gazette.llm import embed

SCHEMA = "vec_id long, embedding array<float>, label int, home string, name string"


def brute(rows):
    usable = [r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
              and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) if ok else None for r, ok in zip(rows, usable)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(len(rows)) if j != i and usable[i] and usable[j] and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((r[0], len(near[i]), component, r[0] is not None and r[0] == component))
    return sorted(out, key=repr)


def documents():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        c = rng.standard_normal(8)
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (c + 0.08 * rng.standard_normal(8)).tolist(), int(rng.integers(0, 2))))
    rows += [(1000, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]), (None, [9.0] * 8, 5),
             (1001, None, 1), (1002, [0.0] * 8, 1), (1003, [float("nan")] + [1.0] * 7, 1), (1004, [None] + [1.0] * 7, 1),
             (1005, [float("inf")] + [1.0] * 7, 1), (1006, rows[3][1], None), (1007, [1.0] * 3, 1), (1008, [], 1),
             (1009, [1.0] * 3, 1), (1010, [2.0] * 3, 1), (1011, [1.0] * 3, 0), (1012, [1.0, 1.0, -1.0], 1), (1013, [3.0], 1), (1014, [-3.0], 1),
             (2000, rows[5][1], rows[5][2]), (2000, rows[9][1], rows[9][2]), (2000, [0.5] * 8, 1 - rows[5][2])]
    return rows


def found(spark, rows, **params):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, embed.near_duplicate_vectors(df, **params).collect()), key=repr)


@pytest.mark.parametrize("params", [{}, {"per_cell": 4, "tile": 3}])
def test_against_all_pairs(spark, params):
    rows = documents()
    assert found(spark, rows, **params) == brute(rows)


def test_cells_are_visited_in_order_of_cost():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 6))
    grid = embed.fit(x / np.linalg.norm(x, axis=1)[:, None], 7, 0.9, 0.99)
    entry = grid.entry(x / np.linalg.norm(x, axis=1)[:, None])
    row, cell = grid.visits(entry)
    cost = entry[0][row, cell // 7] + entry[1][row, cell % 7]
    within = entry[0][:, :, None] + entry[1][:, None, :] <= grid.reach
    assert sorted(zip(row, cell)) == sorted((a, b * 7 + c) for a, b, c in zip(*np.nonzero(within)))
    for r in range(300):
        assert (np.diff(cost[row == r]) >= 0).all() and cell[row == r][0] == grid.home(entry)[r]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_recall_over_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table])
    x /= np.linalg.norm(x, axis=1)[:, None]
    # the table's vectors are far apart: every second one gets near partners
    rng = np.random.default_rng(4)
    near = np.repeat(x[::2], 2, axis=0)
    noise = rng.standard_normal(near.shape)
    noise -= (noise * near).sum(1)[:, None] * near
    noise *= rng.uniform(0.05, 0.25, len(near))[:, None] / np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate([x, near + noise]).astype(np.float32).astype(float)
    label = np.concatenate([[r.label for r in table], np.repeat([r.label for r in table[::2]], 2)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((unit @ unit.T >= 0.98) & (label[:, None] == label)).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), int(k), "x", "y") for i, (v, k) in enumerate(zip(x, label))], SCHEMA)
    got = {r.vec_id: r.n_links for r in embed.near_duplicate_vectors(df, per_cell=16).collect()}
    assert want.sum() > 1000 and all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.999 * want.sum()
