"""Everything that is fitted can be saved, and is the same when it is loaded."""

import numpy as np
import pandas as pd
import pytest

from metricloom.learning import store
from metricloom.operators import outliers, scale
from metricloom.plans import runs
from metricloom.session import scratch_path

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).normal(size=(300, 3)) * [1, 5, 0.1]
    x[:6] += [9, 40, 3]
    return spark.createDataFrame(pd.DataFrame({"time": range(300), **{n: x[:, i] for i, n in enumerate(NAMES)}})).cache()


@pytest.mark.parametrize("fit", [
    scale.fit_standard, scale.fit_robust, scale.fit_minmax, scale.fit_quantile, scale.fit_power, scale.fit_pca,
    outliers.fit_hbos, outliers.fit_cblof, outliers.fit_reconstruction,
], ids=lambda f: f.__name__)
def test_loaded_states_do_the_same(spark, rows, fit):
    path = scratch_path(spark, "state")
    fitted = fit(rows, NAMES)
    store.save_state(spark, fitted, path)
    again = store.load_state(spark, path)
    act = "transform" if hasattr(fitted, "transform") else "score"
    one, other = (getattr(f, act)(rows).orderBy("time").collect() for f in (fitted, again))
    assert type(again) is type(fitted) and [tuple(r) for r in one] == [tuple(r) for r in other]


def test_absent_and_unknown_states(spark):
    assert store.load_state(spark, scratch_path(spark, "none")) is None
    with pytest.raises(ValueError, match="not saved"):
        store.save_state(spark, object(), scratch_path(spark, "object"))


@pytest.mark.parametrize("method, scaler", [("hbos", None), ("cblof", "QuantileTransformer"), ("reconstruction", "PowerTransformer")])
def test_runs_of_other_detectors_and_scalers(spark, rows, method, scaler):
    spec = runs.RunSpec(scratch_path(spark, "run"), method=method, scaler=scaler, options={"contamination": 0.02})
    assert runs.detect(rows, spec) is None
    runs.train(rows, spec)
    found = runs.detect(rows, spec)
    assert 1 <= found.count() <= 7 and {r.method for r in found.collect()} == {method}
    assert runs.detect(rows.drop("b"), spec).count() >= 0  # a lost series is filled
