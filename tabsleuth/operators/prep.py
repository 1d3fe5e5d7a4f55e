"""Preparation for baseline models (G1-G6, G15 folds).

Splits and folds are deterministic functions of a key: rows are ranked per
class by a 64-bit key hash (or any order column) with the two-level prefix
sum, so no class - however large - is sorted inside one task. Fitted
statistics (medians, modes, means, top levels) are small per-column tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as ty
from ..functions.ranking import cumulative_by_value
from .clean import fill_value, medians, modes

TEST_FRACTION = 0.2
SEED = 42
N_FOLDS = 5
MAX_CATEGORIES = 20
INFREQUENT = "infrequent"


def hash_order(key: str | list[str], seed: int = SEED, salt: int | None = None) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.col(f"`{k}`") for k in keys] + [F.lit(seed)] + ([F.lit(salt)] if salt is not None else [])
    return F.xxhash64(*parts)


def rank_within(df: DataFrame, group: str | None, order: Column) -> DataFrame:
    """Add ``_rank`` (1-based) and ``_n`` (group size) by ``order`` within
    ``group`` (the whole table when None; NULL is a group of its own). Equal
    ``order`` values are taken by a hash of the row, so only equal rows are
    interchangeable."""
    g = F.col(f"`{group}`") if group else F.lit(0)
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    x = df.select("*", g.alias("_grp"), order.alias("_ordv"), F.xxhash64(*plain).alias("_tie"), F.lit(1).alias("_one"))
    cum = cumulative_by_value(x, ["_grp"], "_ordv", ["_one"], ties=["_tie"])
    return cum.withColumn("_rank", F.col("cum__one")).withColumn("_n", F.col("total__one")).drop("_grp", "_ordv", "_tie", "_one", "cum__one", "total__one")


def stratified_split(df: DataFrame, label: str, key: str | list[str], test_fraction: float = TEST_FRACTION, seed: int = SEED, order_col: str | None = None) -> DataFrame:
    """G1: add boolean ``is_test``: per class the first ceil(f * n_class) rows
    in hash (or ``order_col``) order; rows with a NULL label are a class of
    their own. A class with one member is an error."""
    small = df.groupBy(F.col(f"`{label}`")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 2).limit(1).collect()
    if small:
        raise ValueError(f"The least populated class in {label} has only 1 member; stratified split impossible")
    order = F.col(f"`{order_col}`") if order_col else hash_order(key, seed)
    r = rank_within(df, label, order)
    return r.withColumn("is_test", F.col("_rank") <= F.ceil(F.col("_n") * test_fraction)).drop("_rank", "_n")


def random_split(df: DataFrame, key: str | list[str], test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Repeatable split by key hash (independent of partitioning)."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed)), F.lit(100))
    return df.withColumn("is_test", h < int(round(test_fraction * 100)))


def assign_folds(df: DataFrame, key: str | list[str], label: str | None = None, k: int = N_FOLDS, seed: int = SEED, order_col: str | None = None) -> DataFrame:
    """G15 folds: ``fold`` = (rank - 1) mod k, ranked per class (stratified)
    or over all rows, in hash (or ``order_col``) order."""
    order = F.col(f"`{order_col}`") if order_col else hash_order(key, seed)
    r = rank_within(df, label, order)
    return r.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_n")


# ---------------------------------------------------------------- fitted transformers

@dataclass
class Preprocessor:
    """G6 fitted state: per-column statistics learnt on the training rows."""

    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)  # column -> list of kept levels (ordered)
    infrequent: dict = field(default_factory=dict)  # column -> bool (an 'infrequent' slot exists)

    def slots(self) -> list[tuple[str, str | None]]:
        """(column, level) of every slot of the feature vector, in order."""
        out: list[tuple[str, str | None]] = [(c, None) for c in self.numeric]
        for c in self.categorical:
            out += [(c, v) for v in [*self.levels[c], *([INFREQUENT] if self.infrequent[c] else [])]]
        return out

    def feature_names(self) -> list[str]:
        return [c if v is None else f"{c}={v}" for c, v in self.slots()]


def impute_fit(train: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[dict, dict]:
    """G3 fit: numeric medians, categorical most frequent (ties: smallest)."""
    return medians(train, numeric), modes(train, categorical)


def impute_apply(df: DataFrame, med: dict, mod: dict) -> DataFrame:
    """G3 apply."""
    out = []
    for f in df.schema.fields:
        c = ty.clean_col(df, f.name)
        if f.name in med and med[f.name] is not None:
            out.append(fill_value(c, f.dataType, med[f.name]).alias(f.name))
        elif f.name in mod and mod[f.name] is not None:
            out.append(F.coalesce(c, F.lit(mod[f.name])).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)


def scale_fit(train: DataFrame, numeric: list[str]) -> tuple[dict, dict]:
    """G4 fit: mean and population std per column (one aggregation)."""
    if not numeric:
        return {}, {}
    row = train.agg(*[x for i, c in enumerate(numeric) for x in (F.avg(ty.numeric_value(train, c)).alias(f"m{i}"), F.stddev_pop(ty.numeric_value(train, c)).alias(f"s{i}"))]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(numeric)}, {c: row[f"s{i}"] for i, c in enumerate(numeric)}


def scale_apply(df: DataFrame, means: dict, stds: dict) -> DataFrame:
    """G4 apply: (x - mean) / std_pop; a zero std scales by 1."""
    out = []
    for f in df.schema.fields:
        if f.name in means:
            s = stds[f.name] if stds[f.name] not in (None, 0.0) else 1.0
            out.append(((ty.numeric_value(df, f.name) - F.lit(means[f.name])) / F.lit(s)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def one_hot_fit(train: DataFrame, categorical: list[str], max_categories: int = MAX_CATEGORIES) -> tuple[dict, dict]:
    """G5 fit: levels kept per column - all when at most ``max_categories``,
    else the max_categories-1 most frequent (ties: smaller value) plus an
    'infrequent' slot. Reads the per-column frequency table only."""
    from .distributions import value_counts_topk
    from .profile import frequency_table

    if not categorical:
        return {}, {}
    freq = frequency_table(train, categorical)
    n_levels = {r["column"]: r["u"] for r in freq.where(F.col("value").isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("u")).collect()}
    top = value_counts_topk(freq, k=max_categories, max_unique=None).collect()  # <= columns x k rows
    levels, infrequent = {}, {}
    for c in categorical:
        rows = sorted([r for r in top if r["column"] == c], key=lambda r: r["rank"])
        if n_levels.get(c, 0) > max_categories:
            levels[c] = sorted(r["value"] for r in rows[: max_categories - 1])
            infrequent[c] = True
        else:
            levels[c] = sorted(r["value"] for r in rows)
            infrequent[c] = False
    return levels, infrequent


def one_hot_level(df: DataFrame, column: str, levels: list[str], has_infrequent: bool) -> Column:
    """G5 bucketed form: the kept level, 'infrequent', or NULL (unknown)."""
    v = F.col(f"`{column}`").cast("string")
    kept = v.isin(*levels) if levels else F.lit(False)
    return F.when(kept, v).when(v.isNotNull() & F.lit(has_infrequent), F.lit(INFREQUENT))


def one_hot_columns(df: DataFrame, column: str, levels: list[str], has_infrequent: bool) -> list[Column]:
    lv = one_hot_level(df, column, levels, has_infrequent)
    cols = [F.coalesce((lv == F.lit(x)).cast("double"), F.lit(0.0)).alias(f"{column}={x}") for x in levels]
    if has_infrequent:
        cols.append(F.coalesce((lv == F.lit(INFREQUENT)).cast("double"), F.lit(0.0)).alias(f"{column}={INFREQUENT}"))
    return cols


def preprocess_fit(train: DataFrame, features: list[str]) -> Preprocessor:
    """G6 fit: median+scale for numeric features, mode+one-hot for text;
    other columns are dropped."""
    num = [c for c in features if ty.family(train.schema[c].dataType) == ty.NUMERIC]
    cat = [c for c in features if ty.family(train.schema[c].dataType) == ty.STRING]
    med, mod = impute_fit(train, num, cat)
    filled = impute_apply(train.select(*[F.col(f"`{c}`") for c in num + cat]), med, mod)
    means, stds = scale_fit(filled, num)
    levels, infrequent = one_hot_fit(filled, cat)
    return Preprocessor(num, cat, med, mod, means, stds, levels, infrequent)


def preprocess_apply(df: DataFrame, prep: Preprocessor, keep: list[str] | None = None, vector: str | None = "features") -> DataFrame:
    """G6 apply: the ``keep`` columns, and the expanded features as a vector
    (or, with ``vector=None``, as one column per slot). Slots are assembled by
    position, so names and levels may hold any character."""
    keep = keep or []
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    own = [c for c in prep.numeric + prep.categorical]
    raw = df.select(*kept, *[F.col(f"`{c}`").alias(c) for c in own])
    scaled = scale_apply(impute_apply(raw, prep.medians, prep.modes), prep.means, prep.stds)
    cols = [F.col(f"_k{i}") for i in range(len(keep))] + [F.col(f"`{c}`") for c in prep.numeric]
    if vector:
        return _sparse_features(scaled, prep, keep, cols, vector)
    for c in prep.categorical:
        cols += one_hot_columns(scaled, c, prep.levels[c], prep.infrequent[c])
    slots = [f"_s{i}" for i in range(len(cols) - len(keep))]
    out = scaled.select(*cols).toDF(*[f"_k{i}" for i in range(len(keep))], *slots)
    return out.toDF(*keep, *prep.feature_names())


def _sparse_features(scaled: DataFrame, prep: Preprocessor, keep: list[str], plain: list[Column], vector: str) -> DataFrame:
    """The ``keep`` columns and the feature vector: a text column is one level
    index, which an encoder with a fixed number of levels makes a sparse block
    of the vector; an unknown level (the index after the last) is all zeros."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    size = {c: len(prep.levels[c]) + bool(prep.infrequent[c]) for c in prep.categorical}
    coded = [c for c in prep.categorical if size[c]]
    names = [f"_k{i}" for i in range(len(keep))] + [f"_n{i}" for i in range(len(prep.numeric))] + [f"_i{i}" for i in range(len(coded))]
    index = []
    for c in coded:
        known = F.array(*[F.lit(v) for v in [*prep.levels[c], *([INFREQUENT] if prep.infrequent[c] else [])]])
        at = F.array_position(known, one_hot_level(scaled, c, prep.levels[c], prep.infrequent[c]))
        index.append(F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(size[c])).cast("double"))
    rows = scaled.select(*plain, *index).toDF(*names)
    if coded:
        # the encoder learns only how many levels a column has
        most = scaled.sparkSession.createDataFrame([tuple(float(min(k, size[c] - 1)) for c in coded) for k in range(max(size[c] for c in coded))], [f"_i{i}" for i in range(len(coded))])
        rows = OneHotEncoder(inputCols=[f"_i{i}" for i in range(len(coded))], outputCols=[f"_h{i}" for i in range(len(coded))], handleInvalid="keep", dropLast=True).fit(most).transform(rows)
    parts = [f"_n{i}" for i in range(len(prep.numeric))] + [f"_h{i}" for i in range(len(coded))]
    out = VectorAssembler(inputCols=parts, outputCol=vector, handleInvalid="keep").transform(rows)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], vector)
