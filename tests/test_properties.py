"""Property tests (hypothesis): exact sizes, disjoint and complete splits, AUL in
[0, 1] and equal to the pair formula, top-n equal to a full sort."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkpul.operators import metrics as M
from sparkpul.operators import ranking
from sparkpul.operators import splits as S

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(n=st.integers(1, 120), frac=st.floats(0.0, 1.0), seed=st.integers(0, 10_000))
def test_stratified_split_sizes(spark, n, frac, seed):
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "y": (np.arange(n) % 4 == 0).astype(np.int64)})
    out = S.stratified_split(spark.createDataFrame(pdf), "id", "y", frac, seed).toPandas()
    assert sorted(out["id"]) == list(range(n))
    for cls, part in out.groupby("y"):
        assert (part["split"] == "val").sum() == math.floor(frac * len(part))


@SETTINGS
@given(scores=st.lists(st.integers(0, 5), min_size=2, max_size=60), data=st.data())
def test_aul_pair_formula(spark, scores, data):
    y = data.draw(st.lists(st.integers(0, 1), min_size=len(scores), max_size=len(scores)))
    if sum(y) == 0:
        y[0] = 1
    pdf = pd.DataFrame({"y": np.asarray(y, dtype=np.int64), "s": np.asarray(scores, dtype=float)})
    got = M.aul(spark.createDataFrame(pdf), "y", "s").first()["aul"]
    ys, ss = np.asarray(y), np.asarray(scores, dtype=float)
    acc = sum(1.0 if a > b else (0.5 if a == b else 0.0) for a in ss[ys == 1] for b in ss)
    assert abs(got - acc / (ys.sum() * len(ys))) < 1e-12
    assert 0.0 <= got <= 1.0


@SETTINGS
@given(scores=st.lists(st.integers(0, 4), min_size=1, max_size=50), k=st.integers(0, 50), desc=st.booleans())
def test_top_n_is_sort_prefix(spark, scores, k, desc):
    pdf = pd.DataFrame({"id": np.arange(len(scores), dtype=np.int64), "s": np.asarray(scores, dtype=float)})
    out = ranking.top_n(spark.createDataFrame(pdf), "s", "id", k, descending=desc).toPandas()
    want = set(pdf.sort_values(["s", "id"], ascending=[not desc, True])["id"].head(k))
    assert set(out[out.selected]["id"]) == want
