"""Explainability and findings.

Permutation importance permutes one column by an equi-join on row ranks
(key order vs. key-hash order), so no row order is assumed and nothing goes
through the driver. TreeSHAP reads the saved MLlib tree nodes (bounded by
model size, not data size), broadcasts them and evaluates the exact
path-dependent algorithm for a batch of rows at once inside ``mapInArrow``:
bit patterns of satisfied path features look up per-leaf weight tables.
Importance summaries work on long (run, feature, importance) tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .prep import hash_order, rank_within

SEED = 42
REPEATS = 5
TOP_INSIGHTS, TOP_REPORT, TOP_CHART = 5, 10, 15
DOMINANT_IMPORTANCE = 0.1


# ---------------------------------------------------------------- I1 permutation importance

def _in_key_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows' rank by key (``_kr``) and number (``_n``)."""
    return rank_within(df, None, _key_order(keys)).withColumnRenamed("_rank", "_kr")


def _permuted(df: DataFrame, base: DataFrame, columns: list[str], keys: list[str], repeat: int, seed: int, method: str) -> DataFrame:
    """``df`` with ``_perm_<i>`` for each of ``columns``: the row at key-rank r
    receives the values of the row at rank r in key-hash order (hash of key,
    seed, repeat), or of key-rank r+1 (cyclic) with ``method='shift'``. Ranks
    come from the two-level prefix sum (``base``: :func:`_in_key_order`, the
    same for all repeats); the exchange is one equi-join on rank that carries
    only these columns."""
    values = [F.col(f"`{c}`").alias(f"_perm_{i}") for i, c in enumerate(columns)]
    if method == "shift":
        rank = F.when(F.col("_kr") == 1, F.col("_n")).otherwise(F.col("_kr") - 1)
        donors = base.select(rank.alias("_kr"), *values)
    else:
        narrow = df.select(*dict.fromkeys([*keys, *columns]))
        donors = rank_within(narrow, None, hash_order(keys, seed, salt=repeat)).select(F.col("_rank").alias("_kr"), *values)
    return base.drop("_n").join(donors, "_kr").drop("_kr")


def permute_column(df: DataFrame, column: str, key: str | list[str], repeat: int = 0, seed: int = SEED, method: str = "hash") -> DataFrame:
    """``df`` with one column permuted."""
    keys = [key] if isinstance(key, str) else list(key)
    return _swapped(_permuted(df, _in_key_order(df, keys), [column], keys, repeat, seed, method), df.columns, column, 0)


def _swapped(permuted: DataFrame, columns: list[str], column: str, i: int) -> DataFrame:
    return permuted.select(*[F.col(f"_perm_{i}").alias(c) if c == column else F.col(f"`{c}`") for c in columns])


def _key_order(keys: list[str]):
    """An order of the rows by their key (hashed if it has several columns)."""
    return F.col(f"`{keys[0]}`") if len(keys) == 1 else hash_order(keys, 0)


#: column that tells the copies of a row apart: 0 as it is, i with feature i swapped
COPY = "_copy"


def _stacked(permuted: DataFrame, columns: list[str], features: list[str], first: int) -> DataFrame:
    """One copy of the rows for each feature, with that feature swapped
    (``COPY`` = 1, 2, ...), and with ``first`` = 0 the rows as they are too."""
    copies = permuted.withColumn(COPY, F.explode(F.sequence(F.lit(first), F.lit(len(features)))))
    place = {f: i for i, f in enumerate(features)}
    value = lambda c: F.when(F.col(COPY) == place[c] + 1, F.col(f"_perm_{place[c]}")).otherwise(F.col(f"`{c}`")).alias(c) if c in place else F.col(f"`{c}`")
    return copies.select(*[value(c) for c in columns], COPY)


def permutation_importance(
    df: DataFrame,
    features: list[str],
    predict: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame, str], DataFrame],
    key: str | list[str],
    repeats: int = REPEATS,
    seed: int = SEED,
    method: str = "hash",
) -> DataFrame:
    """Importance of each raw feature = score(original) - score(with the
    feature permuted), mean and population std over ``repeats``.

    ``predict`` maps rows to rows with predictions and keeps the column
    ``COPY``; ``score(predictions, column)`` gives (column, score) rows by a
    grouped aggregation. The rows are ranked by key once; a repeat ranks the
    features by hash and joins them to the rows once, stacks one copy a feature, and predicts and scores the stack, so
    the number of jobs does not depend on the number of features."""
    keys = [key] if isinstance(key, str) else list(key)
    drops: dict[str, list[float]] = {f: [] for f in features}
    base = None
    repeats = repeats if method == "hash" else 1
    ranked = _in_key_order(df, keys)
    ranked = materialize(ranked) if repeats > 1 else ranked
    for repeat in range(repeats):
        permuted = materialize(_permuted(df, ranked, features, keys, repeat, seed, method))
        stack = _stacked(permuted, df.columns, features, 0 if base is None else 1)
        scores = {r[0]: r[1] for r in score(predict(stack), COPY).collect()}
        base = scores[0] if base is None else base
        for i, f in enumerate(features):
            drops[f].append(base - scores[i + 1])
    rows = [(f, float(np.mean(d)), float(np.std(d))) for f, d in drops.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double")


def explain_baseline(run, features: list[str], key: str | list[str], model: str | None = None, repeats: int = REPEATS) -> DataFrame:
    """I1 for a fitted baseline (the best one unless named) over all rows of
    its run. The score is the ROC AUC for two classes, if the model gives
    probabilities, else the accuracy; -MSE for regression."""
    from pyspark.ml.functions import vector_to_array

    from . import metrics as mt

    name = model or run.best()
    rows = run.train.unionByName(run.test)

    def score(pred: DataFrame, by: str) -> DataFrame:
        p = pred.select(by, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), *([vector_to_array("probability").alias("prob")] if "probability" in pred.columns else []))
        if run.task != "classification":
            return p.groupBy(by).agg((-F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))).alias("score"))
        if len(run.classes) == 2 and "prob" in p.columns:
            return mt.roc_auc(p.withColumn("score", F.col("prob")[1]), positive=1.0, by=by)
        return mt.accuracy(p, by=by)

    keys = [key] if isinstance(key, str) else list(key)
    return permutation_importance(rows, features, lambda d: run.predict(d, name, [*keys, "label", COPY]), score, key, repeats).withColumn("model", F.lit(name))


# ---------------------------------------------------------------- I2 TreeSHAP

def _tree_tables(model, spark, kind: str) -> list[dict]:
    """Nodes of every tree of an MLlib tree model, read back from its saved
    parquet data: [{id: (left, right, feature, threshold, cats, cover, value_vec)}]."""
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()  # bounded by model size
    else:
        rows = data.select(F.lit(0).alias("treeID"), "*").collect()
    trees: dict[int, dict] = {}
    for r in rows:
        sp = r["split"]
        stats = list(r["impurityStats"] or [])
        trees.setdefault(r["treeID"], {})[r["id"]] = (
            r["leftChild"],
            r["rightChild"],
            sp["featureIndex"] if sp is not None else -1,
            list(sp["leftCategoriesOrThreshold"]) if sp is not None else [],
            sp["numCategories"] if sp is not None else -1,
            float(r["rawCount"]),
            float(r["prediction"]),
            stats,
        )
    return [_with_covers(trees[t], kind) for t in sorted(trees)]


def _with_covers(tree: dict, kind: str) -> dict:
    """Covers that add up exactly: a leaf's weighted training count (from its
    impurity statistics), an inner node's the sum of its children's."""
    out: dict = {}

    def cover(nid: int) -> float:
        node = tree[nid]
        if node[0] == -1:
            stats = node[7]
            c = float(stats[0]) if kind == "regression" else float(sum(stats))
            c = c if c > 0 else max(node[5], 1.0)
        else:
            c = cover(node[0]) + cover(node[1])
        out[nid] = node[:5] + (c,) + node[6:]
        return c

    cover(_root(tree))
    return out


def _root(tree: dict) -> int:
    children = {n[0] for n in tree.values()} | {n[1] for n in tree.values()}
    return next(i for i in tree if i not in children)


def _leaf_value(node, kind: str, cls: int) -> float:
    if kind == "classification":
        stats = node[7]
        tot = sum(stats)
        return stats[cls] / tot if tot > 0 else 0.0
    return node[6]


def _goes_left(node, x: np.ndarray) -> np.ndarray:
    feat, cats, ncat = node[2], node[3], node[4]
    v = x[:, feat]
    if ncat == -1:
        return v <= cats[0]
    return np.isin(v, np.array(cats))


#: patterns up to which a leaf's whole weight table is made at once
TABLE_FEATURES = 12
#: bytes of weight tables that a task keeps for its next batches
TABLE_BYTES = 64 << 20


def leaf_weights(cover: list[float], value: float, bits: np.ndarray | None = None) -> np.ndarray:
    """Contributions of the features on one leaf's path, one row a feature and
    one column a pattern of satisfied features (all 2^d patterns, or those
    given as the rows of ``bits``).

    The Shapley weight of a feature i, given which others are satisfied (o_j)
    and the share of training rows that satisfy each (z_j), is the integral
    over t in [0, 1] of prod_{j != i} (o_j t + z_j (1 - t)): a polynomial of
    degree d - 1, so ceil(d / 2) Gauss-Legendre nodes give it exactly."""
    d = len(cover)
    t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
    t, w = (t + 1) / 2, w / 2
    z = np.maximum(np.array(cover), 1e-30)
    off = z[None, :] * (1 - t[:, None])  # nodes x features
    on = off + t[:, None]
    if bits is not None:
        factor = np.where(bits[None], on[:, None, :], off[:, None, :])  # nodes x patterns x features
        whole = factor.prod(axis=2) * (w * value)[:, None]
        return ((whole[:, :, None] / factor).sum(axis=0) * (bits - z)).T
    whole = (w * value)[:, None]
    for i in range(d):  # feature i is bit i
        whole = np.concatenate([whole * off[:, i, None], whole * on[:, i, None]], axis=1)
    out = np.empty((d, 1 << d))
    for i in range(d):
        halves = whole.reshape(len(t), -1, 2, 1 << i)
        out[i].reshape(-1, 2, 1 << i)[:, 0] = (halves[:, :, 0] / off[:, i, None, None]).sum(axis=0) * -z[i]
        out[i].reshape(-1, 2, 1 << i)[:, 1] = (halves[:, :, 1] / on[:, i, None, None]).sum(axis=0) * (1 - z[i])
    return out


class WeightTables:
    """Weight tables of leaves, kept while they fit into ``TABLE_BYTES``."""

    def __init__(self):
        self.kept: dict = {}
        self.size = 0

    def get(self, key, cover: list[float], value: float) -> np.ndarray:
        table = self.kept.get(key)
        if table is None:
            table = leaf_weights(cover, value)
            if self.size + table.nbytes <= TABLE_BYTES:
                self.kept[key] = table
                self.size += table.nbytes
        return table


def tree_shap_batch(tree: dict, x: np.ndarray, kind: str, cls: int = 1, tables: WeightTables | None = None, number: int = 0) -> tuple[np.ndarray, float]:
    """Exact path-dependent TreeSHAP of one tree for a batch of rows.

    What a leaf adds to a row depends only on which of the distinct features
    on its path have all their conditions satisfied. On the way down each row
    carries that as a bit pattern (one bit a feature, one vector operation a
    node), and at the leaf the pattern looks the contributions up in the
    leaf's table. Paths of more than ``TABLE_FEATURES`` features get the
    weights of the patterns that occur, in place of a table."""
    phi = np.zeros((x.shape[1], len(x)))
    tables = tables or WeightTables()
    root = _root(tree)
    stack = [(root, np.zeros(len(x), dtype=np.int64), [], [])]
    while stack:
        nid, pattern, feats, cover = stack.pop()
        node = tree[nid]
        if node[0] == -1:
            value = _leaf_value(node, kind, cls)
            if not feats or value == 0.0:
                continue
            if len(feats) <= TABLE_FEATURES:
                table = tables.get((number, nid), cover, value)
            else:
                seen, pattern = np.unique(pattern, return_inverse=True)
                table = leaf_weights(cover, value, (seen[:, None] >> np.arange(len(feats)) & 1).astype(bool))
            for f, weights in zip(feats, table, strict=True):
                phi[f] += weights[pattern]
            continue
        left = _goes_left(node, x)
        f = node[2]
        for child, goes in ((node[0], left), (node[1], ~left)):
            share = tree[child][5] / node[5] if node[5] > 0 else 0.0
            if f in feats:
                k = feats.index(f)
                z = cover[:k] + [cover[k] * share] + cover[k + 1:]
                stack.append((child, np.where(goes, pattern, pattern & ~(1 << k)), feats, z))
            else:
                stack.append((child, pattern | (goes.astype(np.int64) << len(feats)), [*feats, f], [*cover, share]))
    return phi.T, _expected_value(tree, root, kind, cls)


def _expected_value(tree: dict, nid: int, kind: str, cls: int) -> float:
    node = tree[nid]
    if node[0] == -1:
        return _leaf_value(node, kind, cls)
    c = node[5] if node[5] > 0 else 1.0
    return (tree[node[0]][5] * _expected_value(tree, node[0], kind, cls) + tree[node[1]][5] * _expected_value(tree, node[1], kind, cls)) / c


def tree_shap(model, df: DataFrame, id_cols: list[str], feature_names: list[str], features: str = "features", kind: str = "regression", cls: int = 1) -> DataFrame:
    """SHAP contributions of a tree model (decision tree or random
    forest; other models are not explained) for every row of ``df`` ->
    long (ids..., feature, value) plus one 'base_value' row per input row.
    Forests average their trees. ``cls`` picks the class whose probability
    is explained (the positive class for binary problems). Memory of a task:
    one Arrow batch of rows, its contributions and ``TABLE_BYTES`` of tables."""
    import pyarrow as pa
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import types as T

    spark = df.sparkSession
    trees = _tree_tables(model, spark, kind)
    bc = spark.sparkContext.broadcast(trees)  # model-sized, not data-sized
    names = [*feature_names, "base_value"]
    x = df.select(*[F.col(f"`{c}`") for c in id_cols], vector_to_array(F.col(features)).alias("_x"))
    schema = T.StructType([*x.schema.fields[:-1], T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])

    def run(batches):
        ts, tables = bc.value, WeightTables()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = batch.column(len(id_cols)).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
            total, base = np.zeros((n, len(names))), 0.0
            for k, t in enumerate(ts):
                phi, b0 = tree_shap_batch(t, rows, kind, cls, tables, k)
                total[:, :-1] += phi
                base += b0
            total[:, -1] = base
            ids = [pa.concat_arrays([batch.column(i)] * len(names)) for i in range(len(id_cols))]
            feature = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names), dtype=np.int32), n)), pa.array(names)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*ids, feature, pa.array((total / len(ts)).T.ravel())], names=[f.name for f in schema.fields])

    return x.mapInArrow(run, schema)


# ---------------------------------------------------------------- I3-I8 importance tables and findings

def shap_importance(contrib: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Mean |contribution| per feature (base value excluded)."""
    g = group_cols or []
    return contrib.where(F.col("feature") != "base_value").groupBy(*g, "feature").agg(F.avg(F.abs("value")).alias("importance"))


def top_features(imp: DataFrame, k: int = TOP_INSIGHTS, group_cols: list[str] | None = None) -> DataFrame:
    """I4: top-k features per run by importance (ties by name), with the
    run's count of positive importances. Runs have few features, so the
    window per run is small."""
    g = ["run"] if group_cols is None else group_cols
    w = Window.partitionBy(*g).orderBy(F.col("importance").desc(), F.col("feature"))
    pos = imp.groupBy(*g).agg(F.count_if(F.col("importance") > 0).alias("n_positive"))
    ranked = imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (ranked.join(pos, g) if g else ranked.crossJoin(pos)).select(*g, "rank", "feature", "importance", "n_positive")


def weak_and_dominant_features(imp: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per run, features with importance <= 0 (weak) and whether the top
    importance exceeds .1 (dominant) -> (run, feature, kind)."""
    g = ["run"] if group_cols is None else group_cols
    weak = imp.where(F.col("importance") <= 0).select(*g, "feature", F.lit("weak").alias("kind"))
    top = imp.groupBy(*g).agg(F.min_by("feature", F.struct(-F.col("importance"), F.col("feature"))).alias("feature"), F.max("importance").alias("m"))
    dom = top.where(F.col("m") > DOMINANT_IMPORTANCE).select(*g, "feature", F.lit("dominant").alias("kind"))
    return weak.unionByName(dom)


def importance_stats(imp: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Mean, std (population), max, min, zero count and ratio, quartiles
    and the top-5 / top-10 feature lists per run."""
    g = ["run"] if group_cols is None else group_cols
    v = F.col("importance")
    ranked = F.array_sort(F.collect_list(F.struct((-v).alias("k"), F.col("feature").alias("f"))))
    return imp.groupBy(*g).agg(
        F.avg(v).alias("mean_importance"),
        F.stddev_pop(v).alias("std_importance"),
        F.max(v).alias("max_importance"),
        F.min(v).alias("min_importance"),
        F.count_if(v == 0).alias("zero_importance_count"),
        (F.count_if(v == 0) / F.count(F.lit(1))).alias("zero_importance_ratio"),
        F.percentile(v, 0.25).alias("q25"),
        F.percentile(v, 0.5).alias("q50"),
        F.percentile(v, 0.75).alias("q75"),
        F.array_join(F.transform(F.slice(ranked, 1, 5), lambda s: s["f"]), ",").alias("top_5_features"),
        F.array_join(F.transform(F.slice(ranked, 1, 10), lambda s: s["f"]), ",").alias("top_10_features"),
        F.transform(F.slice(ranked, 1, 5), lambda s: F.round(-s["k"], 6)).alias("top_5_scores"),
        F.transform(F.slice(ranked, 1, 10), lambda s: F.round(-s["k"], 6)).alias("top_10_scores"),
    )


def performance_level(scores: DataFrame, task: str, value: str = "value") -> DataFrame:
    """I8: classification > .9 excellent, > .8 good, > .6 moderate, else
    poor; regression on -RMSE with > -.1, > -.5, > -1.0."""
    v = F.col(value)
    if task == "classification":
        lvl = F.when(v > 0.9, "excellent").when(v > 0.8, "good").when(v > 0.6, "moderate").otherwise("poor")
    else:
        lvl = F.when(v > -0.1, "excellent").when(v > -0.5, "good").when(v > -1.0, "moderate").otherwise("poor")
    return scores.withColumn("performance_level", lvl)


def dataset_findings(df: DataFrame, high_missing_pct: float = 30.0, results: DataFrame | None = None, task: str | None = None, importances: DataFrame | None = None) -> DataFrame:
    """One (section, item, value) table: shape, missing %, high-missing
    (30 %), constant and high-cardinality columns, strong correlations and
    multicollinear columns, and - when the rows of a training run are given -
    the best model, its score and level, models trained and failed, and the
    top-5 features."""
    from ..functions import types as ty
    from . import profile as pr
    from .models import select_best_model
    from .relations import multicollinear_columns, pearson, strong_pairs, vif

    prof = materialize(pr.column_profile(df))
    ov = pr.dataset_overview(df)
    text = lambda c, digits: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    row = lambda frame, section, item, value: frame.select(F.lit(section).alias("section"), (F.lit(item) if isinstance(item, str) else item).alias("item"), value.alias("value"))
    parts = [
        row(ov, "dataset", "rows", F.col("total_rows").cast("string")),
        row(ov, "dataset", "columns", F.col("total_cols").cast("string")),
        row(ov, "dataset", "missing_percentage", text("missing_percentage", 2)),
        row(pr.high_missing_columns(prof, high_missing_pct), "high_missing", F.col("column"), text("missing_pct", 2)),
        row(pr.constant_columns(prof), "constant", F.col("column"), F.col("unique_count").cast("string")),
        row(pr.high_cardinality_columns(prof), "high_cardinality", F.col("column"), F.col("unique_count").cast("string")),
    ]
    if len(ty.numeric_columns(df)) >= 2:
        count = F.count(F.lit(1)).cast("string").alias("n")
        parts.append(row(strong_pairs(pearson(df)).agg(count), "relationships", "strong_correlations", F.col("n")))
        parts.append(row(multicollinear_columns(vif(df)).agg(count), "relationships", "multicollinear_columns", F.col("n")))
    if results is not None:
        best = performance_level(select_best_model(results), task or "classification", "best_score")
        failed = results.groupBy("model").agg(F.max((F.col("metric") == "error").cast("int")).alias("failed"))
        counts = failed.agg(F.count_if(F.col("failed") == 0).cast("string").alias("ok"), F.count_if(F.col("failed") == 1).cast("string").alias("bad"))
        parts += [
            row(best, "modeling", "best_model", F.col("best_model")),
            row(best, "modeling", "best_score", text("best_score", 4)),
            row(best, "modeling", "performance_level", F.col("performance_level")),
            row(counts, "modeling", "models_trained", F.col("ok")),
            row(counts, "modeling", "models_failed", F.col("bad")),
        ]
    if importances is not None:
        parts.append(row(top_features(importances, TOP_INSIGHTS, []), "top_features", F.col("feature"), text("importance", 4)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_summary(df: DataFrame, target: str, task: str, results: DataFrame, importances: DataFrame, name: str = "table") -> DataFrame:
    """A6 content: one row of structs - metadata (name, shape, target, task),
    data quality (missing %, warnings), modelling (best model, trained and
    failed counts), the top-5 importances, and recommendations (findings by
    section)."""
    from .clean import quality_findings
    from .profile import dataset_overview

    ov = dataset_overview(df)
    warnings = quality_findings(df).agg(F.count(F.lit(1)).alias("warnings_count"), F.array_sort(F.collect_list(F.concat_ws(": ", "check", "column"))).alias("warnings"))
    found = materialize(dataset_findings(df, results=results, task=task, importances=importances))  # a few rows per column
    item = lambda i: F.max(F.when((F.col("section") == "modeling") & (F.col("item") == i), F.col("value")))
    modeling = found.agg(item("best_model").alias("best_model"), item("models_trained").cast("long").alias("models_trained"), item("models_failed").cast("long").alias("models_failed"))
    top = top_features(importances, TOP_INSIGHTS, []).agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "importance"))).alias("t"))
    advice = found.where(F.col("section").isin("high_missing", "constant", "high_cardinality", "relationships")).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    advice = advice.agg(F.array_sort(F.collect_list("section")).alias("sections"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_recommendations"))
    one = ov.crossJoin(warnings).crossJoin(modeling).crossJoin(top).crossJoin(advice)  # one row each
    return one.select(
        F.struct(F.lit(name).alias("dataset"), F.col("total_rows"), F.col("total_cols"), F.lit(target).alias("target_column"), F.lit(task).alias("task_type")).alias("metadata"),
        F.struct(F.round("missing_percentage", 6).alias("missing_data_pct"), "warnings_count", "warnings").alias("data_quality"),
        F.struct("best_model", "models_trained", "models_failed").alias("modeling"),
        F.struct(F.lit("permutation_importance").alias("method"), F.transform("t", lambda x: x["feature"]).alias("top_features"), F.transform("t", lambda x: F.round(x["importance"], 6)).alias("top_scores")).alias("feature_importance"),
        F.struct("sections", "total_recommendations").alias("recommendations"),
    )
