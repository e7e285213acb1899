"""Exact nearest vectors against brute force, with queries in one block and in many."""

import math

import numpy as np
import pytest

from memlode.operators.vectors import above, top_k


@pytest.mark.parametrize("block", [8192, 7])
def test_top_k_and_theta_join(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)).astype("f4")
    x[50] = x[51]
    rows = [(k, [float(v) for v in x[k]]) for k in range(120)] + [(900, [math.nan] * 4), (901, [0.0] * 4), (902, None), (903, [1.0]), (904, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    asked = df.where("id % 5 = 0 or id >= 900")
    got = {}
    for r in top_k(df, asked, id_col="id", vector="v", dims=4, k=3, block=block).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: sorted(range(120), key=lambda j: (-round(s[q, j], 12), j))[:3] for q in range(0, 120, 5)}
    pairs = {(r.qid, r.id) for r in above(df, asked, id_col="id", vector="v", dims=4, threshold=0.8, block=block).collect()}
    assert pairs == {(q, j) for q in range(0, 120, 5) for j in range(120) if s[q, j] >= 0.8}
    assert top_k(df.limit(0), df.limit(0), id_col="id", vector="v", dims=4, k=3, block=block).count() == 0
