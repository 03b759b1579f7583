"""Detectors and models against brute force and their invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import evaluate, explain, selection, store, supervised
from metricloom.operators import analysis, neighbours, outliers, scale, training_labels


def brute_dbscan(x, eps, least):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (gaps <= eps).sum(1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = number
        while stack:
            for j in np.flatnonzero(gaps[stack.pop()] <= eps):
                if core[j] and label[j] == -1:
                    label[j] = number
                    stack.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        near = [label[j] for j in np.flatnonzero(gaps[i] <= eps) if core[j]]
        if near:
            label[i] = min(near)
    return label


@pytest.fixture(scope="module")
def cloud():
    """Three groups, noise, and one point that holds a third of all rows."""
    rng = np.random.default_rng(3)
    parts = [rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (2, 0), (5, 5))]
    parts += [rng.uniform(-4, 9, (40, 2)), np.tile([[0.1, 0.2]], (110, 1))]
    x = np.round(np.vstack(parts), 3)
    return rng.permutation(x)


@pytest.mark.parametrize("block_rows", [25, 5000])
def test_dbscan_equals_brute_force(spark, cloud, block_rows):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(cloud)), "a": cloud[:, 0], "b": cloud[:, 1]}))
    got = neighbours.dbscan(df.repartition(5), ["a", "b"], "i", 0.4, 5, block_rows=block_rows)
    assert got.count() == len(cloud)
    labels = got.toPandas().sort_values("i")["cluster"].to_numpy()
    assert labels.tolist() == brute_dbscan(cloud, 0.4, 5).tolist()


def test_few_edges_take_one_task(spark, monkeypatch):
    """A round of few edges has no exchange and no broadcast, and is the round of many."""
    dice = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in dice.integers(0, 300, (200, 2)) if a != b] * 2
    edges = neighbours.stored(spark.createDataFrame(pairs, "u long, v long").repartition(7), "edges")
    once = neighbours._task_round(edges)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    many = neighbours._small_star(neighbours._large_star(edges))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, many.collect()))
    few = sorted(map(tuple, neighbours.components(edges).collect()))
    monkeypatch.setattr(neighbours, "TASK_EDGES", 20)
    assert sorted(map(tuple, neighbours.components(edges).collect())) == few


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    other = spark.createDataFrame([(1000, 1003), (1003, 1001)], "u long, v long")
    got = neighbours.components(edges.union(other)).groupBy("v").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 200), (1000, 2)]


@pytest.mark.parametrize("block_rows", [30, 5000])
def test_neighbours_and_angles_equal_brute_force(spark, cloud, block_rows):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(cloud)), "a": cloud[:, 0], "b": cloud[:, 1]}))
    points = neighbours.merged_points(df, ["a", "b"], "i")
    near = neighbours.nearest_neighbours(points, 4, block_rows=block_rows)
    distinct = np.unique(cloud, axis=0)
    gaps = np.sqrt(((distinct[:, None] - distinct[None]) ** 2).sum(-1))
    want = np.sort(gaps, axis=1)[:, 1:5]
    got = near.groupBy("id").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("gap")).alias("g")).toPandas()
    at = {tuple(r): i for i, r in enumerate(distinct)}
    assert len(got) == len(distinct)
    for x, g in zip(got["x"], got["g"]):
        assert np.allclose(g, want[at[tuple(x)]])
    scored = neighbours.abod_scores(df, ["a", "b"], "i", 4, block_rows=block_rows).toPandas()
    copies = scored[(scored["a"] == 0.1) & (scored["b"] == 0.2)]
    assert copies["score"].isna().all() and scored["score"].notna().sum() == len(cloud) - len(copies)
    one = scored[scored["score"].notna()].iloc[0]
    i = at[(one["a"], one["b"])]
    order = [j for j in np.argsort(gaps[i], kind="stable") if j != i][:4]
    weights = {tuple(r): int((cloud == r).all(1).sum()) for r in distinct}
    legs = []
    for j in order:
        legs += [distinct[j] - distinct[i]] * weights[tuple(distinct[j])]
    legs = np.array(legs[:4])
    angles = [legs[a] @ legs[b] / (legs[a] @ legs[a]) / (legs[b] @ legs[b]) for a in range(4) for b in range(a + 1, 4)]
    assert one["score"] == pytest.approx(-np.var(angles))


def test_forest_finds_planted_rows_whatever_the_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    x[:20] += 9
    df = spark.createDataFrame(pd.DataFrame({"i": range(2000), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    found = []
    for parts in (1, 7):
        forest = outliers.fit_isolation_forest(df.repartition(parts), ["a", "b", "c"], ["i"], 40, contamination=0.01)
        flagged = forest.predict(df).where("prediction = -1")
        found.append(sorted(r["i"] for r in flagged.collect()))
    assert found[0] == found[1] and found[0] == list(range(20))


def test_forest_samples_are_full(spark):
    df = spark.range(10_000).withColumn("a", F.rand(1))
    dealt = outliers._deal_rows(df, ["id"], 30, 64, 10_000, 1)
    counts = dealt.groupBy("_tree").count().collect()
    assert len(counts) == 30 and {r["count"] for r in counts} == {64}


@pytest.fixture(scope="module")
def wide_rows(spark):
    x = np.random.default_rng(5).normal(size=(3000, 3)).round(3)
    x[:15] = 40 + np.arange(45).reshape(15, 3)
    x[100:130, 1] = np.nan
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double"), x


def _wide_forest(df, **options):
    options = {"n_estimators": 6, "max_samples": 1.0, "task_sample": 100, **options}
    return outliers.fit_isolation_forest(df, ["a", "b", "c"], ["id"], **options)


def test_forest_over_all_rows_counts_every_row_in_its_leaf(wide_rows):
    df, x = wide_rows
    forest = _wide_forest(df)
    for tree in forest.trees:
        cuts = [np.asarray(tree[k]) for k in ("feature", "threshold", "low", "high")]
        leaves, sizes = np.unique(outliers._leaves(x, cuts), return_counts=True)
        cover, low, high = (np.asarray(tree[k]) for k in ("cover", "low", "high"))
        assert cover[leaves].tolist() == sizes.tolist() and cover[0] == len(x)
        inner = np.flatnonzero(low != np.arange(len(low)))
        assert (cover[low[inner]] + cover[high[inner]] == cover[inner]).all()
        assert (cover[inner] > 1).all() and (cover[low[inner]] > 0).all() and (cover[high[inner]] > 0).all()


def test_forest_over_all_rows_flags_planted_rows_whatever_the_partitions(wide_rows):
    df, _ = wide_rows
    once = _wide_forest(df.repartition(3), n_estimators=20, contamination=15 / 3000)
    again = _wide_forest(df.repartition(7, "a"), n_estimators=20, contamination=15 / 3000)
    assert once == again
    flagged = once.predict(df).where("prediction = -1").select("id").collect()
    assert sorted(r[0] for r in flagged) == list(range(15))


@pytest.mark.parametrize("options, mean", [({"max_samples": 0.5}, 1500), ({"bootstrap": True}, 3000)])
def test_forest_over_shares_and_repeated_draws(wide_rows, options, mean):
    forest = _wide_forest(wide_rows[0], **options)
    roots = [t["cover"][0] for t in forest.trees]
    assert len(set(roots)) > 1 and all(abs(n - mean) < 6 * math.sqrt(mean) for n in roots)


def test_forest_levels_are_bounded_and_constant_rows_are_one_leaf(spark, wide_rows, monkeypatch):
    monkeypatch.setattr(outliers, "WIDE_LEVELS", 3)
    monkeypatch.setattr(outliers, "_STATE_CELLS", 100)  # two trees at a time
    shallow = _wide_forest(wide_rows[0], max_features=2)
    for tree in shallow.trees:
        cut = {f for at, (f, low) in enumerate(zip(tree["feature"], tree["low"])) if low != at}
        assert len(tree["feature"]) <= 15 and 1 <= len(cut) <= 2
    same = spark.range(500).selectExpr("id", "1.0D AS a", "CAST(NULL AS DOUBLE) AS b", "2.0D AS c")
    assert all(t["cover"] == [500] for t in _wide_forest(same).trees)


def test_large_and_small_clusters():
    assert outliers.split_by_size([50, 45, 3, 2], 0.9, 5) == [True, True, False, False]
    assert outliers.split_by_size([60, 10, 30], 0.99, 2.5) == [True, False, True]


def test_reconstruction_error_of_rows_off_the_line(spark):
    rng = np.random.default_rng(6)
    t = rng.normal(size=300)
    pdf = pd.DataFrame({"i": range(300), "a": t, "b": 2 * t, "c": -t})
    pdf.loc[7, "b"] += 6
    scored = outliers.reconstruction_error(spark.createDataFrame(pdf), ["a", "b", "c"], 1)
    assert scored.orderBy(F.col("score").desc()).first()["i"] == 7


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.integers(0, 30, 250), "y": rng.normal(size=250).round(1)})
    pdf.loc[:90, ["x", "y"]] = [3, 0.5]
    sx = np.sign(np.subtract.outer(pdf["x"].to_numpy(), pdf["x"].to_numpy()))
    sy = np.sign(np.subtract.outer(pdf["y"].to_numpy(), pdf["y"].to_numpy()))
    want = (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())
    got = analysis.kendall_tau(spark.createDataFrame(pdf), "x", "y").first()["value"]
    assert got == pytest.approx(want, abs=1e-12)


def test_shapiro_of_a_published_sample(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(float(w), float(i)) for i, w in enumerate(weights)], "w double, i double")
    got = {r["feature"]: r["w"] for r in analysis.rank_shapiro(df, ["w", "i"]).collect()}
    assert got["w"] == pytest.approx(0.78881, abs=2e-4) and got["i"] > 0.95


def test_power_transform_maximises_likelihood(spark):
    x = np.exp(np.random.default_rng(8).normal(size=500))
    df = spark.createDataFrame(pd.DataFrame({"a": x}))
    fitted = scale.fit_power(df, ["a"])

    def fit(lam):
        y = (np.power(x + 1, lam) - 1) / lam if lam else np.log1p(x)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log1p(x).sum()

    best = max(np.linspace(-3, 1, 4001), key=fit)
    assert fitted.lambdas["a"] == pytest.approx(best, abs=5e-3)
    out = fitted.transform(df).toPandas()["a"]
    assert out.mean() == pytest.approx(0, abs=1e-9) and out.std(ddof=0) == pytest.approx(1)


def test_training_labels(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 1, (900, 2)), rng.normal(12, 0.1, (40, 2)), rng.normal(-12, 0.1, (40, 2)), [[30, -30]]])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    options = dict(eps=0.5, min_samples=4, contamination=0.12, n_estimators=60)
    got = training_labels.generate_training_labels(df, ["a", "b"], "i", **options).toPandas().sort_values("i")
    assert len(got) == len(x)
    labels = got["target"].to_numpy()
    assert len(set(labels[900:940])) == 1 and len(set(labels[940:980])) == 1
    assert len({0, labels[900], labels[940], labels[980]}) == 4


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(900, 3))
    kind = np.where(x[:, 0] + x[:, 1] > 0.5, "cpu", np.where(x[:, 0] < -0.5, "mem", "0"))
    pdf = pd.DataFrame({"i": range(900), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": kind})
    return spark.createDataFrame(pdf).repartition(2).cache()


@pytest.mark.parametrize(
    "name, options",
    [
        ("decision_tree", {"maxDepth": 5}),
        ("random_forest", {"numTrees": 10}),
        ("gbt", {"maxIter": 5}),
        ("mlp", {"hidden": (8,), "maxIter": 60}),
        ("adaboost", {"n_estimators": 6, "max_depth": 2}),
    ],
)
def test_classifiers_learn_and_reload(spark, classes, tmp_path, name, options):
    model = supervised.fit_classifier(classes, ["a", "b", "c"], "y", name, **options)
    found = model.append(classes)
    assert evaluate.scores(found, "y", "pred").first()["accuracy"] > 0.8
    if "prob_0" in found.columns:
        total = found.select((q("prob_0") + q("prob_1") + q("prob_2")).alias("s"))
        assert total.where("abs(s - 1) > 1e-6").isEmpty()
    path = store.model_path(str(tmp_path), name, "t")
    store.save_classifier(spark, model, path)
    again = store.load_classifier(spark, path).append(classes)
    assert found.select("i", "pred").exceptAll(again.select("i", "pred")).isEmpty()
    assert store.load_classifier(spark, path + "x") is None


def test_shapley_values_add_up(spark, classes):
    model = supervised.fit_classifier(classes, ["a", "b", "c"], "y", "decision_tree", maxDepth=4)

    def score(df):
        return model.append(df).withColumnRenamed("prob_1", "score")

    base = explain.background_rows(classes, ["a", "b", "c"], ["i"], 6)
    some = classes.where("i < 12")
    values = explain.shapley_rows(some, ["a", "b", "c"], "i", score, base, 4)
    sums = values.groupBy("i").agg(
        (F.sum("phi") + F.first("base_value") - F.first("score")).alias("gap"),
        F.first("score").alias("score"),
    )
    assert sums.count() == 12 and sums.where("abs(gap) > 1e-9").isEmpty()
    direct = score(some).select("i", F.col("score").alias("direct"))
    assert sums.join(direct, "i").where("abs(score - direct) > 1e-9").isEmpty()


def test_elimination_drops_the_useless_feature(classes):
    folds = selection.fold_pairs(selection.stratified_folds(classes, "y", ["i"], 3), 3)
    found = selection.rfe(folds, ["a", "b", "c"], "y", "decision_tree", {"maxDepth": 5})
    ranks = {r["feature"]: r["ranking"] for r in found}
    assert ranks["a"] == ranks["b"] == 1


def test_search_remembers(classes):
    folds = selection.fold_pairs(selection.stratified_folds(classes, "y", ["i"], 2), 2)
    search = selection.Search(folds, ["a", "b"], "y", "decision_tree")
    table = selection.hpo_evolution(search, {"maxDepth": [1, 3]}, population=3, generations=2)
    assert len(table) <= 2 and table[0]["f1_weighted"] >= table[-1]["f1_weighted"]
    assert search.best()["maxDepth"] == 3


def test_a_walk_ends_where_single_steps_do():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 4))
    x[::9, 2] = np.nan
    cuts = [np.asarray(c) for c in ([1, 0, 2, 3, 0, 2, 0, 0, 0], [0.1, 0.0, -0.4, 0.3, 0, 0.9, 0, 0, 0], [3, 1, 5, 1, 4, 7, 6, 7, 8], [2, 1, 8, 4, 4, 6, 6, 7, 8])]
    want = []
    for row in x:
        node = 0
        while cuts[2][node] != node:
            node = cuts[2][node] if row[cuts[0][node]] <= cuts[1][node] else cuts[3][node]
        want.append(node)
    assert outliers._leaves(x, cuts).tolist() == want and outliers._Walk(cuts).steps == 3


def test_leaves_of_the_last_level_are_only_counted(wide_rows, monkeypatch):
    asked, plain = [], outliers._level_sums
    monkeypatch.setattr(outliers, "_level_sums", lambda *given: asked.append(given[3]) or plain(*given))
    monkeypatch.setattr(outliers, "WIDE_LEVELS", 3)
    forest = _wide_forest(wide_rows[0])
    assert asked == [3, 3, 3, 0]
    assert all(sum(n for n, at, low in zip(t["cover"], range(99), t["low"]) if at == low) == 3000 for t in forest.trees)


@pytest.mark.parametrize("least", [-np.inf, 0.0])
def test_power_sums_of_parts_are_those_of_the_whole(spark, least):
    x = np.maximum(np.random.default_rng(9).normal(size=4000) * 5 + 2, least)
    rows = [(None if i % 50 == 0 else float(v),) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double").repartition(5)
    trials = {"a": [-1.5, 0.0, 0.7, 2.0, 3.0]}
    found = scale._power_sums(df, ["a"], trials)
    for j, lam in enumerate(trials["a"]):
        y = scale.yeo_johnson(F.col("a"), lam)
        n, variance, lift = df.agg(F.count("a"), F.var_pop(y), F.sum(F.signum("a") * F.log1p(F.abs("a")))).first()
        assert found[0, j][0] == n == 3920
        assert found[0, j][2] / n == pytest.approx(variance) and found[0, j][3] == pytest.approx(lift)
    gone = spark.createDataFrame([(None,), (None,)], "a double")
    assert scale._power_sums(gone, ["a"], trials) == {} and scale.fit_power(gone.unionAll(df), ["a"]).lambdas == scale.fit_power(df, ["a"]).lambdas


def test_kendall_in_many_blocks_with_a_frequent_value(spark, monkeypatch):
    """A value of y that most rows have is counted in no task; bounds, insides and what lies apart add up."""
    monkeypatch.setattr(analysis, "_CELLS_PER_BLOCK", 40)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=900), 2)
    y = np.where(rng.random(900) < 0.6, 3.0, np.round(x + rng.normal(size=900), 1))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3)
    signs = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    up = lambda v: (np.sign(v[:, None] - v[None]) != 0).sum()
    want = signs.sum() / np.sqrt(float(up(x)) * float(up(y)))
    for a, b in (("x", "y"), ("y", "x")):
        assert analysis.kendall_tau(df, a, b).first()["value"] == pytest.approx(want, abs=1e-12)
    n = rng.integers(1, 9, 900)
    less = (x[:, None] < x[None]) & (y[:, None] < y[None])
    pairs = int((less * (n[:, None] * n[None])).sum())
    assert analysis.concordant_pairs(x, y, n) == pairs
    assert analysis.concordant_pairs(x, y, n * 10**8) == pairs * 10**16


def test_normal_scores_of_many_ranges_at_once(monkeypatch):
    calls, whole = [], analysis.normal_quantiles
    monkeypatch.setattr(analysis, "normal_quantiles", lambda s: calls.append(len(s)) or whole(s))
    monkeypatch.setattr(analysis, "_RANKS_PER_CHUNK", 400)
    length = np.resize([1, 1, 3, 400, 2], 500)
    last = length.cumsum()
    first, n = last - length + 1, int(last[-1])
    got = next(analysis._normal_scores.func(iter([tuple(pd.Series(v) for v in (first, last, np.full(500, n)))])))
    scores = whole((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    assert np.allclose(got["m"], [scores[a - 1 : b].sum() for a, b in zip(first, last)])
    assert np.allclose(got["m2"], [(scores[a - 1 : b] ** 2).sum() for a, b in zip(first, last)])
    assert len(calls) <= 201 and max(calls) <= 400 and sum(calls) == n
