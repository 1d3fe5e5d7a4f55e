import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabsleuth.operators import explain, metrics, models, prep

from conftest import SF001


def test_stratified_split_proportions(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    s = prep.stratified_split(o, "o_orderstatus", "o_orderkey")
    for r in s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == math.ceil(0.2 * r["n"])
    assert s.count() == o.count()


def test_stratified_split_rejects_singleton_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, y string")
    with pytest.raises(ValueError):
        prep.stratified_split(df, "y", "k")


def test_folds_balanced_per_class(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    f = prep.assign_folds(o, "o_orderkey", "o_orderstatus")
    for r in f.groupBy("o_orderstatus").agg(F.collect_list("fold").alias("fs")).collect():
        counts = np.bincount(r["fs"], minlength=5)
        assert counts.max() - counts.min() <= 1


def test_tree_shap_additivity(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(2 * a - b + rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(20, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = DecisionTreeRegressor(maxDepth=3, seed=1).fit(d)
    contrib = explain.tree_shap(m, d, ["id"], ["a", "b"])
    s = contrib.groupBy("id").agg(F.sum("value").alias("s")).join(m.transform(d).select("id", "prediction"), "id")
    assert s.select(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0] < 1e-9


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    tr = rng.normal(size=(60, 3))
    te = rng.normal(size=(15, 3))
    ytr = (tr[:, 0] > 0).astype(float)
    from pyspark.ml.linalg import Vectors

    train = spark.createDataFrame([(i, Vectors.dense(x), float(y)) for i, (x, y) in enumerate(zip(tr, ytr))], ["k", "features", "label"])
    test = spark.createDataFrame([(100 + i, Vectors.dense(x)) for i, x in enumerate(te)], ["k", "features"])
    got = {r["k"]: r["prediction"] for r in models.knn_predict(train, test, "k", rows_per_block=20).collect()}
    for i, x in enumerate(te):
        dist = ((tr - x) ** 2).sum(1)
        nn = np.lexsort((np.arange(len(tr)), dist))[:5]
        votes = np.bincount(ytr[nn].astype(int), minlength=2)
        assert got[100 + i] == float(np.argmax(votes))


def test_permutation_shift_is_deterministic(spark):
    df = spark.createDataFrame([(i, float(i % 3), "y" if i % 3 else "n") for i in range(30)], "k int, x double, c string")
    p = explain.permute_column(df, "x", "k", method="shift").orderBy("k").collect()
    assert [r["x"] for r in p] == [float((i + 1) % 30 % 3) for i in range(30)]
    h = explain.permute_column(df, "x", "k", repeat=1)
    assert sorted(r["x"] for r in h.collect()) == sorted(r["x"] for r in df.collect())


def test_unclear_task_must_be_named(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, y double")
    with pytest.raises(ValueError):
        models.train_baselines(df, "y", "k", "unclear")


def _shapley(tree, x, kind):
    """Shapley values by all subsets, the tree's expectation as the game."""
    n, root = x.shape[1], explain._root(tree)

    def value(nid, row, known):
        node = tree[nid]
        if node[0] == -1:
            return explain._leaf_value(node, kind, 0)
        if node[2] in known:
            return value(node[0] if explain._goes_left(node, row[None])[0] else node[1], row, known)
        return sum(tree[c][5] * value(c, row, known) for c in node[:2]) / node[5]

    out = np.zeros_like(x)
    for r, row in enumerate(x):
        for i in range(n):
            for k in range(n):
                for some in itertools.combinations([j for j in range(n) if j != i], k):
                    weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                    out[r, i] += weight * (value(root, row, {*some, i}) - value(root, row, set(some)))
    return out


@pytest.mark.parametrize("table_features", [0, 2, 12])
def test_tree_shap_equals_all_subsets(monkeypatch, table_features):
    """With the weight table of a leaf, and with the patterns that occur."""
    monkeypatch.setattr(explain, "TABLE_FEATURES", table_features)
    rng = np.random.default_rng(5)

    def grow(tree, depth, n):
        nid = len(tree)
        if depth == 0 or n < 2:
            tree[nid] = (-1, -1, -1, [], -1, float(n), float(rng.normal()), [float(n)])
            return nid
        tree[nid], feature, k = None, int(rng.integers(5)), int(rng.integers(1, n))
        tree[nid] = (grow(tree, depth - 1, k), grow(tree, depth - 1, n - k), feature, [float(rng.normal())], -1, float(n), 0.0, [float(n)])
        return nid

    for _ in range(4):
        tree: dict = {}
        grow(tree, 6, 40)
        x = rng.normal(size=(9, 5))
        assert np.allclose(explain.tree_shap_batch(tree, x, "regression")[0], _shapley(tree, x, "regression"), atol=1e-12)


def test_stacked_importance_equals_one_feature_at_a_time(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    run = models.train_baselines(o.where("o_orderstatus <> 'P'"), "o_orderstatus", "o_orderkey", "classification", ["o_totalprice", "o_custkey", "o_orderpriority"], models=["Naive Bayes"], cv_folds=0)
    feats = ["o_totalprice", "o_custkey", "o_orderpriority"]
    got = {r["feature"]: r for r in explain.explain_baseline(run, feats, "o_orderkey", repeats=2).collect()}
    rows = run.train.unionByName(run.test)

    def auc(df):
        from pyspark.ml.functions import vector_to_array

        p = run.predict(df, "Naive Bayes").select(F.col("label").alias("y_true"), vector_to_array("probability")[1].alias("score"))
        return metrics.roc_auc(p, positive=1.0).first()[0]

    base = auc(rows)
    for f in feats:
        drops = [base - auc(explain.permute_column(rows, f, "o_orderkey", repeat)) for repeat in range(2)]
        assert got[f]["importance_mean"] == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[f]["importance_std"] == pytest.approx(np.std(drops), abs=1e-9)


@pytest.mark.parametrize(("cell", "block"), [(10, 8), (25, 1000), (10**6, 15)])
def test_knn_with_pivots_equals_brute_force(spark, monkeypatch, cell, block):
    """Clusters of unlike size, repeated rows, cells with fewer than k rows."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(models, "CELL_ROWS", cell)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 4)) * 20
    tr = np.concatenate([middle[rng.choice(6, 200, p=[0.6, 0.2, 0.1, 0.06, 0.03, 0.01])] + rng.normal(size=(200, 4)), np.repeat(middle[:1], 30, axis=0)]).round(1)
    te = np.concatenate([middle[rng.integers(0, 6, 40)] + rng.normal(size=(40, 4)), [[500.0] * 4], tr[:3]])
    y = rng.integers(0, 3, len(tr)).astype(float)
    train = spark.createDataFrame([(i, Vectors.dense(x), float(v)) for i, (x, v) in enumerate(zip(tr, y))], ["k", "features", "label"])
    test = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(te)], ["k", "features"])
    got = {r["k"]: r for r in models.knn_predict(train, test, "k", rows_per_block=block, n_classes=3).collect()}
    assert len(got) == len(te)
    for i, x in enumerate(te):
        near = np.lexsort((np.arange(len(tr)), ((tr - x) ** 2).sum(1).round(9)))[:5]
        votes = np.bincount(y[near].astype(int), minlength=3)
        assert got[i]["prediction"] == votes.argmax()
        assert got[i]["probability"].toArray().tolist() == (votes / 5).tolist()
    counts = models.knn_pruning(train, test, "k", rows_per_block=block).first()
    assert counts["pairs"] == len(tr) * len(te) and counts["compared"] <= counts["pairs"]
    if cell == 10:
        assert counts["pruned_share"] > 0.5
    assert models.knn_predict(train.limit(0), test, "k").count() == 0
    assert models.knn_predict(train, test.limit(0), "k").count() == 0


def test_side_by_side_equals_one_after_another(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    feats = ["o_totalprice", "o_custkey", "o_orderpriority"]
    names = ["Naive Bayes", "K-Nearest Neighbors", "Decision Tree"]
    runs = [models.train_baselines(o, "o_orderstatus", "o_orderkey", "classification", feats, models=names, cv_folds=3, parallelism=n).results for n in (1, 4)]
    one, many = ({(r["model"], r["metric"]): r["value"] for r in run.where("metric <> 'train_seconds'").collect()} for run in runs)
    assert one.keys() == many.keys() and {m for m, _ in one} == set(names)
    assert all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)
    assert all((n, m) in one for n in names for m in ("cv_mean", "roc_auc_ovr", "log_loss", "primary_score"))


def test_a_failing_fold_gives_its_error(spark):
    df = spark.createDataFrame([(i, float(i % 3), float(i % 2), i % 4) for i in range(40)], "k int, a double, label double, fold int")

    def fit(rows):
        raise RuntimeError("did not fit")

    assert models.cross_validate_score(df, fit, "classification", ["a"], ["k"]) == (None, "did not fit")


def test_permutation_ranks_rows_by_key_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(60)], "k int, x double, y_true double")
    ranked = []
    real = explain.rank_within
    monkeypatch.setattr(explain, "rank_within", lambda d, g, order: ranked.append(d.columns) or real(d, g, order))
    predict = lambda d: d.withColumn("y_pred", F.pmod(F.col("x"), F.lit(3.0)))
    got = explain.permutation_importance(df, ["x"], predict, lambda p, by: metrics.accuracy(p, by=by), "k", repeats=3).first()
    assert len(ranked) == 4  # once by key, once a repeat by hash
    base = metrics.accuracy(predict(df)).first()[0]
    drops = [base - metrics.accuracy(predict(explain.permute_column(df, "x", "k", repeat))).first()[0] for repeat in range(3)]
    assert got["importance_mean"] == pytest.approx(np.mean(drops), abs=1e-12)


@pytest.mark.parametrize("known", [True, False])
def test_knn_compares_a_row_with_boxes_in_reach_only(monkeypatch, known):
    """A block four times as large does not cost a row more comparisons; equal
    rows, empty sides and values of unlike spread as by brute force."""
    rng = np.random.default_rng(3)
    compared = []
    real = models._distances
    monkeypatch.setattr(models, "_distances", lambda a, b: compared.append(len(a) * len(b)) or real(a, b))
    work = []
    for n in (4000, 16000):
        tx = np.concatenate([np.column_stack([rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, n)]), np.zeros((700, 3))])
        tid = rng.permutation(len(tx))
        qx = np.concatenate([tx[rng.choice(n, 300)] + 0.01, [[0.0, 0.0, 0.0], [90.0, -90.0, 7.0]]])
        d = ((qx[:, None] - tx[None]) ** 2).sum(axis=2)
        near = np.array([np.lexsort((tid, row))[:5] for row in d])
        reach = np.sqrt(np.take_along_axis(d, near, 1)[:, -1]) if known else np.full(len(qx), np.inf)
        compared.clear()
        rows, cols, _ = models._nearest(qx, tx, tid, reach, 5)
        work.append(sum(compared))
        assert sorted(zip(rows, cols)) == sorted((i, c) for i, cs in enumerate(near) for c in cs)
    assert work[1] < 2 * work[0] and work[1] < len(qx) * 16000 // 4  # all pairs: 302 x 16,700


def test_a_model_predicts_the_test_rows_once(spark):
    """The metrics read the predictions, not the model, again and again."""
    predicted = spark.sparkContext.accumulator(0)

    def seen(x):
        predicted.add(1)
        return float(x % 2)

    rows = spark.range(50).select((F.col("id") % 3).cast("double").alias("label"), F.udf(seen, "double")(F.col("id")).alias("prediction"))
    assert {r["metric"] for r in models.evaluate_predictions(rows, "classification", [0, 1, 2]).collect()} >= {"accuracy", "f1_macro"}
    assert predicted.value == 50

    class Model:
        def transform(self, d):
            return d

    assert models.fold_score((rows, rows), lambda d: Model(), "classification")[1] is None
    assert predicted.value == 100


def _forest_nodes(spark, model, tmp_path, name):
    model.write().overwrite().save(str(tmp_path / name))
    rows = spark.read.parquet(str(tmp_path / name / "data")).select("treeID", "nodeData.*").collect()
    return sorted((r["treeID"], r["id"], r["prediction"], r["impurity"], tuple(r["impurityStats"]), r["rawCount"], r["gain"], r["leftChild"], r["rightChild"], r["split"]["featureIndex"], tuple(r["split"]["leftCategoriesOrThreshold"]), r["split"]["numCategories"]) for r in rows)


@pytest.mark.parametrize("classes", [2, 3])
def test_a_forest_on_counts_is_the_forest_on_rows(spark, tmp_path, classes):
    """Node for node: two and three classes, plain and one-hot features, zeros,
    a constant feature, more rows than are sampled for thresholds, partitions of unlike size."""
    from pyspark.ml.classification import RandomForestClassifier

    from tabsleuth.operators import forest

    n = 12000
    raw = spark.range(0, n, 1, 3).where("id % 7 < 5 OR id < 3000").selectExpr(
        "id", "CAST(id * 7919 % 1009 AS DOUBLE) AS a", "CASE WHEN id % 3 = 0 THEN 0.0 ELSE CAST(id * 31 % 613 AS DOUBLE) - 300 END AS b", "concat('c', id * 13 % 29 % 4) AS c", "5.0 AS d",
        f"CAST((id * 7919 % 1009 DIV 200 + id * 17 % 11 DIV 4 + id * 13 % 29 % 4) % {classes} AS DOUBLE) AS label")
    fitted = prep.preprocess_fit(raw, ["a", "b", "c", "d"])
    rows = prep.preprocess_apply(raw, fitted, keep=["label"]).checkpoint()
    est = RandomForestClassifier(numTrees=7, maxDepth=5, seed=3)
    assert forest._binned(est, rows) is not None
    plain, counted = est.fit(rows), forest.fit_forest(est, rows)
    assert _forest_nodes(spark, counted, tmp_path, "counted") == _forest_nodes(spark, plain, tmp_path, "plain")
    assert counted.numClasses == classes and counted.transform(rows).select("probability").exceptAll(plain.transform(rows).select("probability")).count() == 0


def test_rows_of_too_many_cells_go_to_the_estimator(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from tabsleuth.operators import forest

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(60).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS label")).checkpoint()
    monkeypatch.setattr(forest, "MAX_CELLS", 10)
    est = RandomForestClassifier(numTrees=3, maxDepth=2, seed=1)
    assert forest._binned(est, rows) is None
    assert forest.fit_forest(est, rows).toDebugString.split(chr(10))[1:] == est.fit(rows).toDebugString.split(chr(10))[1:]


def test_few_rows_enter_other_cells(spark, monkeypatch):
    """Rows whose neighbours cannot lie beyond their cell are done after one
    meeting, and their other columns come along; the rest is as by brute force."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(models, "CELL_ROWS", 300)
    asked = []
    real = models._solved
    monkeypatch.setattr(models, "_solved", lambda q, t, k: asked.append(q.select("qid").distinct().count()) or real(q, t, k))
    rng = np.random.default_rng(4)
    tr, te = rng.normal(size=(6000, 2)), rng.normal(size=(900, 2))
    y = rng.integers(0, 3, len(tr)).astype(float)
    train = spark.createDataFrame([(i, Vectors.dense(x), float(v)) for i, (x, v) in enumerate(zip(tr, y))], ["k", "features", "label"])
    test = spark.createDataFrame([(i % 50, f"r{i}", Vectors.dense(x)) for i, x in enumerate(te)], ["k", "a.b", "features"])
    got = {r["a.b"]: r for r in models.KnnModel(train, ["k"], "classification", 3).transform(test).collect()}
    assert len(got) == len(te) and asked and asked[0] < len(te) // 2
    for i, x in enumerate(te):
        votes = np.bincount(y[((tr - x) ** 2).sum(1).argsort()[:5]].astype(int), minlength=3)
        assert (got[f"r{i}"]["k"], got[f"r{i}"]["prediction"]) == (i % 50, votes.argmax())
        assert got[f"r{i}"]["probability"].toArray().tolist() == (votes / 5).tolist()


def test_auc_of_several_classes_sums_the_scores_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(3), 300).round(2)
    y = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, p)], "y_true int, p0 double, p1 double, p2 double")
    summed = []
    real = metrics.cumulative_by_value
    monkeypatch.setattr(metrics, "cumulative_by_value", lambda f, *a, **k: summed.append(f.schema["g"].dataType.simpleString()) or real(f, *a, **k))
    got = metrics.roc_auc_multiclass(df, [0, 1, 2], ["p0", "p1", "p2"])
    assert summed == ["bigint"]

    def auc(s, pos):
        d = s[pos][:, None] - s[~pos][None]
        return ((d > 0) + (d == 0) / 2).mean()

    pair = lambda a, b: np.mean([auc(p[m][:, i], y[m] == i) for m in [(y == a) | (y == b)] for i in (a, b)])
    row = got.first()
    assert row["roc_auc_ovr"] == pytest.approx(np.mean([auc(p[:, i], y == i) for i in range(3)]), abs=1e-12)
    assert row["roc_auc_ovo"] == pytest.approx(np.mean([pair(0, 1), pair(0, 2), pair(1, 2)]), abs=1e-12)
