import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltmark.operators import quantiles

SHARES = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize(("small", "few"), [(1 << 40, 1), (0, 20_000), (0, 5)])
def test_quantiles_are_exact(spark, monkeypatch, small, few):
    monkeypatch.setattr(quantiles, "SMALL_BYTES", small)
    monkeypatch.setattr(quantiles, "FEW_ROWS", few)
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=900) * 1e-6, [0.0] * 50, [-0.0] * 2, rng.normal(size=300) * 1e5, [1e308, -1e308, 5e-324], [7.5] * 400])
    table = {"a": a, "b": rng.integers(0, 7, len(a)).astype(float), "c": np.where(rng.random(len(a)) < 0.2, np.nan, rng.normal(size=len(a))), "d": [None] * len(a)}
    df = spark.createDataFrame(pd.DataFrame(table), "a double, b double, c double, d double")
    got = quantiles.quantiles(df, {c: F.col(c) for c in "abcd"}, SHARES)
    for c in "abc":
        values = table[c][~np.isnan(table[c])]
        assert got[c][0] == len(values) and np.allclose(got[c][1], np.quantile(values, SHARES), rtol=1e-12, atol=0)
    assert got["d"] == (0, [None] * len(SHARES))
