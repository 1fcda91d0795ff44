"""Recall where a third of the vectors lie in one dense region below the threshold."""

import numpy as np

from barelake.llm import vectors


def test_pairs_in_a_dense_region(spark):
    rng, dim, n = np.random.default_rng(5), 64, 6000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(dim))
    dense = np.sqrt(0.85) * centre + np.sqrt(0.15) * unit(rng.standard_normal((n // 2, dim)))
    rows = unit(np.concatenate([dense, rng.standard_normal((n // 2, dim))]))
    for k in range(300):  # pairs at cosine 0.955 within the region
        side = rng.standard_normal(dim)
        side = unit(side - (side @ rows[k]) * rows[k])
        rows[300 + k] = 0.955 * rows[k] + np.sqrt(1 - 0.955**2) * side
    want = rows @ rows.T >= 0.95
    np.fill_diagonal(want, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in vectors.near_vectors(df).collect())
    print("recall", got, want.sum())
    assert want.sum() >= 600 and got >= 0.99 * want.sum()
