"""The bootstrap band adds up its draws batch by batch."""

import hashlib
import math

import numpy as np

from sparkpul.operators import results as R


def test_rows_are_not_multiplied(spark):
    df = spark.createDataFrame([(i % 3, float(i), i) for i in range(60)], "k int, m double, key long")
    plan = R.bootstrap_band(df, "k", "m", ["key"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_null_keys_metrics_and_groups(spark):
    """Rows without a metric or a key count for nothing; a null k is a k; other k in the batch do not matter."""
    rows = [(None if i % 4 == 0 else i % 4, None if i % 10 == 9 else i / 7, None if i % 13 == 12 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, m double, key long").repartition(3)
    got = {r["k"]: (r["low"], r["high"]) for r in R.bootstrap_band(df, "k", "m", ["key"], 9, 0.8, seed=5).collect()}
    steps = R.poisson_one_cdf()
    for k in (None, 1, 2, 3):
        means = []
        for b in range(9):
            n = total = 0
            for kk, m, key in rows:
                if kk == k and m is not None and key is not None:
                    digits = hashlib.md5(f"5:{key}:{b // 4}".encode()).hexdigest()[8 * (b % 4) :][:8]
                    w = sum(int(digits, 16) / 2**32 >= s for s in steps)
                    n, total = n + w, total + w * m
            means.append(total / n)
        assert np.allclose(got[k], np.quantile(means, [0.1, 0.9]))
    assert math.isfinite(sum(got[None]))
