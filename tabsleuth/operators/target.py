"""Target detection and task inference.

Every score is a column expression over the column profile (one row per
column); the data work is the profile itself plus one mutual-information
job for the predictability bonus. Only profile rows and per-candidate MI
summaries reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types as ty
from . import profile as pr
from .relations import discretise, mi_pairs

# Name patterns and scores of the target heuristics.
STRONG_NAME_PATTERNS = ["target", "label", "class", "outcome", "response", "dependent",
                        "prediction", "predict", "output", "result", "goal", "objective"]
MODERATE_NAME_PATTERNS = ["y", "category", "type", "status", "flag", "indicator"]
WEAK_PREFIXES = ["is_", "has_"]
WEAK_SUFFIXES = ["_flag", "_ind"]
INDEX_NAMES = ["index", "id", "key", "row_id", "record_id"]
OPTION_SKIP_NAMES = ["index", "id", "key", "row_id", "record_id", "uid", "guid"]
BASIC_KEYWORDS = ["target", "label", "class", "outcome", "result", "prediction",
                  "price", "salary", "income", "survived", "diagnosis", "species"]
STRONG_NAME_SCORE = 50
MODERATE_NAME_SCORE = 30
WEAK_NAME_SCORE = 15
LAST_POSITION_SCORE = 20
SECOND_LAST_POSITION_SCORE = 10
PREDICTABILITY_GATE = 10


def _lname() -> Column:
    return F.lower(F.trim(F.col("column")))


def name_score() -> Column:
    """F1"""
    n = _lname()
    strong = F.lit(False)
    for p in STRONG_NAME_PATTERNS:
        strong = strong | n.contains(p)
    moderate = F.lit(False)
    for p in MODERATE_NAME_PATTERNS:
        moderate = moderate | (n == p) | n.endswith("_" + p)
    weak_pre = F.lit(False)
    for p in WEAK_PREFIXES:
        weak_pre = weak_pre | n.startswith(p)
    weak_suf = F.lit(False)
    for p in WEAK_SUFFIXES:
        weak_suf = weak_suf | n.endswith(p)
    return (
        F.when(strong, STRONG_NAME_SCORE).otherwise(0)
        + F.when(moderate, MODERATE_NAME_SCORE).otherwise(0)
        + F.when(weak_pre, WEAK_NAME_SCORE).otherwise(0)
        + F.when(weak_suf, WEAK_NAME_SCORE).otherwise(0)
    ).cast("double")


def position_score(n_cols: int) -> Column:
    """F2"""
    return F.when(F.col("pos") == n_cols - 1, LAST_POSITION_SCORE).when(F.col("pos") == n_cols - 2, SECOND_LAST_POSITION_SCORE).otherwise(0).cast("double")


def stat_score() -> Column:
    """F3"""
    u, n = F.col("unique_count"), F.col("n_rows")
    ratio = F.coalesce(F.try_divide(u, n), F.lit(0.0))
    miss = F.try_divide(F.col("missing_count"), n)
    card = (
        F.when((u >= 2) & (u <= F.least(F.lit(50.0), 0.2 * n)), F.when(u <= 10, 25).otherwise(15))
        .when((F.col("family") == ty.NUMERIC) & (ratio > 0.2), 20)
        .otherwise(0)
    )
    binary = F.when(u == 2, 15).otherwise(0)
    missing = F.when(miss > 0.3, -20).when(miss == 0, 5).otherwise(0)
    return (card + binary + missing).cast("double")


def penalty_score() -> Column:
    """F5"""
    n = _lname()
    return (
        F.when(F.col("is_id_like"), -50).otherwise(0)
        + F.when(n.contains("date") | n.contains("time"), -30).otherwise(0)
        + F.when(n.isin(*INDEX_NAMES), -40).otherwise(0)
        + F.when(F.col("unique_count") <= 1, -100).otherwise(0)
        + F.when((F.col("family") == ty.STRING) & (F.col("mean_length") > 50), -25).otherwise(0)
    ).cast("double")


def mi_task(profile_row) -> str | None:
    """Task used for a candidate's MI: classification for text or for
    numerics with <= min(20, 5 % of rows) distinct values; regression for
    other numerics; None (MI undefined -> 0) for other types."""
    fam, u, n = profile_row["family"], profile_row["unique_count"], profile_row["n_rows"]
    if fam == ty.STRING:
        return "classification"
    if fam == ty.NUMERIC:
        return "classification" if u <= min(20, 0.05 * n) else "regression"
    return None


def predictability(df: DataFrame, profile_rows: list, candidates: list[str]) -> DataFrame:
    """F4 inputs: (column, avg_mi, max_mi) of each candidate against all other
    numeric / text / date columns - one discretisation and one contingency
    job for all (feature, candidate) pairs together."""
    spark = df.sparkSession
    schema = "column string, avg_mi double, max_mi double"
    by_name = {r["column"]: r for r in profile_rows}
    usable = [r["column"] for r in profile_rows if r["family"] in (ty.NUMERIC, ty.STRING, ty.DATETIME)]
    tasks = {c: mi_task(by_name[c]) for c in candidates}
    targets = [c for c in candidates if tasks[c] is not None]
    if not targets:
        return spark.createDataFrame([], schema)
    raw_copies: dict[str, str] = {}  # the names are no column's
    for c in targets:
        if tasks[c] == "classification" and by_name[c]["family"] == ty.NUMERIC:
            name = f"{c}__raw"
            while name in df.columns or name in raw_copies.values():
                name += "_"
            raw_copies[c] = name
    d = discretise(df, usable, raw_copies=raw_copies)
    pairs = []
    for t in targets:
        rep = raw_copies.get(t, t)
        pairs += [(f, rep) for f in usable if f != t]
    if not pairs:
        return spark.createDataFrame([], schema)
    mi = mi_pairs(d, pairs)
    own = F.broadcast(spark.createDataFrame([(raw_copies.get(t, t), t) for t in targets], "var2 string, column string"))  # one row a candidate
    return mi.join(own, "var2").groupBy("column").agg(
        F.avg("value").alias("avg_mi"), F.max("value").alias("max_mi")
    )


def target_candidates(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """F6 (with F1-F5 as columns): every column's target score, floored at 0,
    ranked by score then position."""
    prof = profile if profile is not None else pr.column_profile(df)
    n_cols = len(ty.profilable_columns(df))
    base = prof.select(
        "*",
        name_score().alias("name_score"),
        position_score(n_cols).alias("position_score"),
        stat_score().alias("stat_score"),
        penalty_score().alias("penalty_score"),
    )
    rows = base.collect()  # one row per column
    base = df.sparkSession.createDataFrame(rows, base.schema)  # reuse, do not recompute the profile
    gated = [r["column"] for r in rows if r["name_score"] + r["position_score"] + r["stat_score"] > PREDICTABILITY_GATE]
    pred = predictability(df, rows, gated)
    bonus = (
        F.when(F.col("avg_mi") > 0.1, F.least(F.col("avg_mi") * 100, F.lit(30.0))).otherwise(0.0)
        + F.when(F.col("max_mi") > 0.3, 10.0).otherwise(0.0)
    )
    scored = base.join(F.broadcast(pred), "column", "left").withColumn(
        "predictability_score",
        F.when(F.col("column").isin(gated) if gated else F.lit(False), F.coalesce(bonus, F.lit(0.0))).otherwise(0.0),
    )
    total = F.greatest(
        F.lit(0.0), F.col("name_score") + F.col("position_score") + F.col("stat_score") + F.col("predictability_score") + F.col("penalty_score")
    )
    scored = scored.withColumn("score", total)
    # ranking over one row per column: a small table
    from pyspark.sql import Window

    w = Window.orderBy(F.col("score").desc(), F.col("pos"))
    return scored.select(
        "pos", "column", "name_score", "position_score", "stat_score", "predictability_score", "penalty_score", "score",
        F.row_number().over(w).alias("rank"),
    )


def recommended_target(candidates: DataFrame) -> DataFrame:
    """F6 result: the best candidate and its score as confidence."""
    return candidates.where(F.col("rank") == 1).select(F.col("column").alias("recommended_target"), F.col("score").alias("confidence_score"))


def target_options(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """candidates without id-like, constant, > 80 % missing or
    identifier-named columns; if none remain, every column with score 0."""
    prof = profile if profile is not None else pr.column_profile(df)
    cand = target_candidates(df, prof)
    j = cand.join(prof.select("column", "dtype", "unique_count", "missing_count", "n_rows", "is_id_like"), "column")
    keep = j.where(
        ~F.col("is_id_like")
        & (F.col("unique_count") > 1)
        & ~(F.try_divide(F.col("missing_count"), F.col("n_rows")) > 0.8)
        & ~F.lower(F.col("column")).isin(*OPTION_SKIP_NAMES)
    ).select("pos", "column", "dtype", "unique_count", "missing_count", F.try_divide(F.col("missing_count"), F.col("n_rows")).alias("missing_ratio"), "score", F.lit(False).alias("fallback"))
    if keep.limit(1).count() > 0:
        return keep
    return prof.select("pos", "column", "dtype", "unique_count", "missing_count", F.try_divide(F.col("missing_count"), F.col("n_rows")).alias("missing_ratio"), F.lit(0.0).alias("score"), F.lit(True).alias("fallback"))


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """F8: task type and the target analysis as one row."""
    from .distributions import moments

    prof = pr.column_profile(df.select(F.col(f"`{target}`")))
    counts = df.groupBy(ty.clean_col(df, target).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    cls = counts.agg(F.max(F.when(F.col("k").isNotNull(), F.col("c"))).alias("top"))
    fam_num = ty.family(df.schema[target].dataType) == ty.NUMERIC
    mom = moments(df, [target]) if fam_num else df.sparkSession.createDataFrame(
        [(target, None, None, None, None, None, None, None)],
        "column string, count long, mean double, std double, min double, max double, skewness double, kurtosis double",
    )
    u, n = F.col("unique_count"), F.col("n_rows")
    ratio = F.try_divide(u, n)
    is_cls = (F.col("family") == ty.STRING) | ((F.col("family") == ty.NUMERIC) & (u <= F.least(F.lit(20.0), 0.05 * n)))
    is_reg = (F.col("family") == ty.NUMERIC) & (ratio > 0.05)
    task = F.when(is_cls, "classification").when(is_reg, "regression").otherwise("unclear")
    major = F.try_divide(F.col("top"), n)
    sk = F.col("skewness")
    j = prof.crossJoin(cls).crossJoin(mom.select("mean", "std", "min", "max", "skewness", "kurtosis"))  # 1-row frames
    return j.select(
        F.col("column").alias("target"),
        task.alias("task_type"),
        F.col("dtype").alias("target_dtype"),
        u.alias("unique_values"),
        ratio.alias("unique_ratio"),
        F.col("missing_count"),
        F.try_divide(F.col("missing_count"), n).alias("missing_ratio"),
        F.when(is_cls, F.when(u == 2, "binary").otherwise("multiclass")).alias("classification_type"),
        F.when(is_cls, major).alias("majority_ratio"),
        F.when(is_cls, F.when(major > 0.9, "severely_imbalanced").when(major > 0.7, "imbalanced").otherwise("balanced")).alias("class_balance"),
        *[F.when(~is_cls & is_reg, F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "skewness", "kurtosis")],
        F.when(~is_cls & is_reg, F.when(F.abs(sk) > 2, "highly_skewed").when(F.abs(sk) > 1, "moderately_skewed").otherwise("approximately_normal")).alias("distribution_note"),
        F.when(~is_cls & ~is_reg, F.when(ratio < 0.05, "classification").otherwise("regression")).alias("hint"),
    )


def validate_target(df: DataFrame, manual_target: str) -> DataFrame:
    """a user-named target checked against the data and the automatic
    choice; an unknown column gives valid = false with the error text."""
    spark = df.sparkSession
    if manual_target not in df.columns:
        return spark.createDataFrame(
            [(False, manual_target, f"Column '{manual_target}' not found in dataset")],
            "valid boolean, manual_target string, error string",
        )
    task = infer_task(df, manual_target)
    auto = recommended_target(target_candidates(df))
    return task.crossJoin(auto).select(  # one row each
        F.lit(True).alias("valid"),
        F.lit(manual_target).alias("manual_target"),
        "task_type",
        "recommended_target",
        (F.col("recommended_target") == manual_target).alias("matches_auto"),
        (F.col("missing_ratio") > 0.3).alias("warn_high_missing"),
        ((F.col("task_type") == "classification") & (F.col("class_balance") == "severely_imbalanced")).alias("recommend_rebalancing"),
        ((F.col("task_type") == "regression") & (F.col("distribution_note") == "highly_skewed")).alias("recommend_log_transform"),
    )


def target_candidates_basic(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """the simple scorer - keyword +30, low-cardinality text +20,
    high-cardinality numeric +15, one of the last three columns +10; task
    classification for text or unique ratio < .1."""
    prof = profile if profile is not None else pr.column_profile(df)
    n_cols = len(ty.profilable_columns(df))
    name = F.lower(F.col("column"))
    kw = F.lit(False)
    for k in BASIC_KEYWORDS:
        kw = kw | name.contains(k)
    ratio = F.try_divide(F.col("unique_count"), F.col("n_rows"))
    score = (
        F.when(kw, 30).otherwise(0)
        + F.when((F.col("family") == ty.STRING) & (ratio < 0.1), 20).when((F.col("family") == ty.NUMERIC) & (ratio > 0.8), 15).otherwise(0)
        + F.when(F.col("pos") >= n_cols - 3, 10).otherwise(0)
    )
    from pyspark.sql import Window

    w = Window.orderBy(F.col("score").desc(), F.col("pos"))  # one row per column
    out = prof.select("pos", "column", "dtype", "unique_count", ratio.alias("unique_ratio"), "missing_count", "family", score.cast("double").alias("score"))
    out = out.withColumn("rank", F.row_number().over(w))
    return out.select(
        "pos", "column", "dtype", "unique_count", "unique_ratio", "missing_count", "score", "rank",
        ((F.col("rank") == 1) & (F.col("score") > 20)).alias("recommended"),
        F.when((F.col("rank") == 1) & (F.col("score") > 20), F.least(F.col("score") * 2, F.lit(100.0))).alias("confidence"),
        F.when((F.col("rank") == 1) & (F.col("score") > 20),
               F.when((F.col("family") == ty.STRING) | (F.col("unique_ratio") < 0.1), "classification").otherwise("regression")).alias("task_type"),
    )


def target_profile(df: DataFrame, target: str, task: str) -> DataFrame:
    """unique, missing, missing %, type; class count, balance ratio and
    flags (classification) or mean/std/min/max/skew and flags (regression)."""
    from .distributions import moments

    v = ty.clean_col(df, target)
    base = df.agg(
        F.count_distinct(v).alias("unique_values"),
        F.count_if(v.isNull()).alias("missing_values"),
        (F.try_divide(F.count_if(v.isNull()), F.count(F.lit(1))) * 100).alias("missing_percentage"),
    ).withColumn("data_type", F.lit(ty.type_name(df.schema[target].dataType)))
    flags = [(F.col("missing_percentage") > 5).alias("flag_missing")]
    if task == "classification":
        counts = df.where(v.isNotNull()).groupBy(v.alias("k")).agg(F.count(F.lit(1)).alias("c"))
        cls = counts.agg(
            F.count(F.lit(1)).alias("n_classes"),
            F.coalesce(F.try_divide(F.min("c"), F.max("c")), F.lit(1.0)).alias("class_balance_ratio"),
        )
        j = base.crossJoin(cls)
        return j.select("*", (F.col("class_balance_ratio") < 0.3).alias("flag_imbalance"), (F.col("n_classes") > 10).alias("flag_many_classes"), *flags)
    m = moments(df, [target]).select("mean", "std", "min", "max", F.col("skewness"))
    j = base.crossJoin(m)
    return j.select(
        "*",
        (F.abs("skewness") > 1).alias("flag_skewed"),
        (F.try_divide(F.col("std"), F.col("mean")) > 1).alias("flag_high_variance"),
        *flags,
    )
