"""The fit with station terms against a dense least-squares solution."""

import math

import numpy as np
import pandas as pd
import pytest

from tremolo.operators.regression import station_fit


@pytest.mark.parametrize("stations, rows", [(1, 20), (5, 100), (300, 1500)])
def test_dense_solution(spark, stations, rows):
    rng = np.random.default_rng(stations)
    d = pd.DataFrame({"s": rng.integers(0, stations, rows), "a": rng.normal(size=rows) + 1000, "b": rng.random(rows), "w": rng.random(rows) + 0.1})
    d["y"] = 2 + 0.5 * d.a - 3 * d.b + np.sin(d.s) + rng.normal(size=rows) * 0.1
    names = sorted(d.s.unique())
    x = np.column_stack([np.ones(rows), d.a, d.b, (d.s.to_numpy()[:, None] == names).astype(float)])
    x = np.vstack([x, np.r_[0, 0, 0, np.ones(len(names))]])  # the terms add up to zero
    root = np.sqrt(np.r_[d.w, 1e3 * d.w.sum()])
    want = np.linalg.lstsq(x * root[:, None], np.r_[d.y, 0] * root, rcond=None)[0]
    extra = pd.DataFrame({"s": [0, None, 0, 0], "a": [None, 1.0, 1.0, math.inf], "b": 1.0, "w": [1.0, 1.0, 0.0, 1.0], "y": 1.0})
    df = spark.createDataFrame(pd.concat([d.astype({"s": float}), extra]).astype(object).where(lambda f: f.notna(), None), "s double, a double, b double, w double, y double").repartition(3)
    fit, terms = station_fit(df, "s", "y", ["a", "b"], "w")
    assert np.allclose([fit["constant"], fit["a"], fit["b"]], want[:3], atol=1e-6)
    got = {r.s: r.term for r in terms.collect()}
    assert np.allclose([got[s] for s in names], want[3:], atol=1e-6) and abs(sum(got.values())) < 1e-8


def test_no_rows_and_no_variation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 5.0, 9.0)], "s string, x double, y double")
    fit, terms = station_fit(df, "s", "y", ["x"])
    assert fit["x"] == 0 and fit["constant"] == 6 and {r.s: (r.n, r.term) for r in terms.collect()} == {"a": (2, -3.0), "b": (1, 3.0)}
    fit, terms = station_fit(df.where("false"), "s", "y", ["x"])
    assert math.isnan(fit["constant"]) and math.isnan(fit["x"]) and terms.count() == 0
