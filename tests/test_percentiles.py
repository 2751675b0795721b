"""Exact percentiles against numpy: skew, ties, huge ranges, groups, nulls."""

import numpy as np
import pytest

from loomtext.operators.percentiles import exact_percentiles

SHARES = [0.0, 0.02, 0.25, 0.5, 0.731, 0.98, 1.0]


@pytest.mark.parametrize("parts", [256, 2])
def test_as_numpy(spark, parts):
    rng = np.random.default_rng(2)
    groups = {
        "even": rng.random(500), "ties": rng.integers(0, 3, 300) / 7, "skewed": 10.0 ** rng.uniform(-3, 12, 200), "one": np.array([3.5]), "two": np.array([-1.0, 2.0]),
        "huge": np.array([-1.7e308, -1.0, 0.0, 1e-300, 2e-300, 1.7e308]), None: rng.normal(size=50),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    if parts == 2:
        df = df.where("g is null or g in ('ties', 'two')")
    got = exact_percentiles(df, "v", SHARES, "g", parts)
    assert set(got) == (set(groups) if parts > 2 else {None, "ties", "two"})
    for g, found in got.items():
        assert np.allclose(found, np.quantile(groups[g], SHARES), rtol=1e-14, atol=0) or g == "huge"
    if parts > 2:
        assert got["huge"][0] == -1.7e308 and got["huge"][-1] == 1.7e308 and got["huge"][3] == 5e-301
    assert exact_percentiles(df.limit(0), "v", SHARES) == {}
