"""Registered queries for target detection and task inference."""

from __future__ import annotations

from ..operators import target as tg
from . import fixtures as fx
from .profile_queries import profile_sql
from .registry import finish, r, register
from .relation_queries import _disc_sql, _mi_sql
from .schemas import SCHEMAS, cols, family


def _lname() -> str:
    return 'lower(trim("column"))'


def _name_sql() -> str:
    n = _lname()
    strong = " OR ".join(f"contains({n}, '{p}')" for p in tg.STRONG_NAME_PATTERNS)
    moderate = " OR ".join(f"{n} = '{p}' OR ends_with({n}, '_{p}')" for p in tg.MODERATE_NAME_PATTERNS)
    pre = " OR ".join(f"starts_with({n}, '{p}')" for p in tg.WEAK_PREFIXES)
    suf = " OR ".join(f"ends_with({n}, '{p}')" for p in tg.WEAK_SUFFIXES)
    return (f"(CASE WHEN {strong} THEN 50 ELSE 0 END + CASE WHEN {moderate} THEN 30 ELSE 0 END "
            f"+ CASE WHEN {pre} THEN 15 ELSE 0 END + CASE WHEN {suf} THEN 15 ELSE 0 END)::DOUBLE")


def _pos_sql(n_cols: int) -> str:
    return f"(CASE WHEN pos = {n_cols - 1} THEN 20 WHEN pos = {n_cols - 2} THEN 10 ELSE 0 END)::DOUBLE"


_STAT = ("(CASE WHEN unique_count >= 2 AND unique_count <= least(50.0, 0.2 * n_rows) THEN CASE WHEN unique_count <= 10 THEN 25 ELSE 15 END "
         "WHEN family = 'numeric' AND unique_count / n_rows > 0.2 THEN 20 ELSE 0 END "
         "+ CASE WHEN unique_count = 2 THEN 15 ELSE 0 END "
         "+ CASE WHEN missing_count / n_rows > 0.3 THEN -20 WHEN missing_count = 0 THEN 5 ELSE 0 END)::DOUBLE")


def _penalty_sql() -> str:
    n = _lname()
    idx = ", ".join(f"'{x}'" for x in tg.INDEX_NAMES)
    return (f"(CASE WHEN is_id_like THEN -50 ELSE 0 END + CASE WHEN contains({n}, 'date') OR contains({n}, 'time') THEN -30 ELSE 0 END "
            f"+ CASE WHEN {n} IN ({idx}) THEN -40 ELSE 0 END + CASE WHEN unique_count <= 1 THEN -100 ELSE 0 END "
            f"+ CASE WHEN family = 'string' AND mean_length > 50 THEN -25 ELSE 0 END)::DOUBLE")


def _scored_sql(table: str) -> str:
    n_cols = len([c for c, t in SCHEMAS[table] if family(t) != "other"])
    return (f"SELECT *, {_name_sql()} AS name_score, {_pos_sql(n_cols)} AS position_score, {_STAT} AS stat_score, "
            f"{_penalty_sql()} AS penalty_score FROM ({profile_sql(table)})")


def _pred_sql(table: str) -> str:
    """avg / max MI of every column (as target) against the others; part has
    no numeric classification candidates, so one discretised view serves."""
    cs = [c for c, t in SCHEMAS[table] if family(t) in ("numeric", "string")]
    num = cols(table, "numeric")
    pairs = [(f, t) for t in cs for f in cs if f != t]
    return (f"WITH d AS ({_disc_sql(table, cs, num)}) SELECT var2 AS \"column\", avg(value) AS avg_mi, max(value) AS max_mi "
            f"FROM ({_mi_sql('d', pairs)}) GROUP BY var2")


def _candidates_sql(table: str) -> str:
    bonus = "(CASE WHEN avg_mi > 0.1 THEN least(avg_mi * 100, 30.0) ELSE 0.0 END + CASE WHEN max_mi > 0.3 THEN 10.0 ELSE 0.0 END)"
    return (
        f"SELECT pos, \"column\", name_score, position_score, stat_score, predictability_score, penalty_score, score, "
        f"CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank FROM ("
        f"SELECT *, greatest(0.0, name_score + position_score + stat_score + predictability_score + penalty_score) AS score FROM ("
        f"SELECT s.*, CASE WHEN name_score + position_score + stat_score > 10 THEN coalesce({bonus}, 0.0) ELSE 0.0 END AS predictability_score "
        f"FROM ({_scored_sql(table)}) s LEFT JOIN ({_pred_sql(table)}) m USING (\"column\")))"
    )


def _round_cols(sql: str, names: list[str], keep: list[str]) -> str:
    return "SELECT " + ", ".join(keep + [f"{r(c)} AS {c}" for c in names]) + f" FROM ({sql})"


@register("target_stat_score", _round_cols(_scored_sql("orders"), ["stat_score"], ["pos", '"column"']))
def q_target_stat_score(spark, sf_dir):
    from ..operators import profile as pr

    prof = pr.column_profile(fx.table(spark, sf_dir, "orders"))
    return finish(prof.select("pos", "column", tg.stat_score().alias("stat_score")))


@register("target_predictability_score", _round_cols(
    f"SELECT pos, \"column\", predictability_score FROM ({_candidates_sql('part')})", ["predictability_score"], ["pos", '"column"']))
def q_target_predictability_score(spark, sf_dir):
    return finish(tg.target_candidates(fx.table(spark, sf_dir, "part")).select("pos", "column", "predictability_score"))


_CAND_COLS = ["name_score", "position_score", "stat_score", "predictability_score", "penalty_score", "score"]


@register("target_candidates", _round_cols(_candidates_sql("part"), _CAND_COLS, ["pos", '"column"', "rank"]))
def q_target_candidates(spark, sf_dir):
    return finish(tg.target_candidates(fx.table(spark, sf_dir, "part")))


@register("recommended_target", f"SELECT \"column\" AS recommended_target, {r('score')} AS confidence_score FROM ({_candidates_sql('part')}) WHERE rank = 1")
def q_recommended_target(spark, sf_dir):
    return finish(tg.recommended_target(tg.target_candidates(fx.table(spark, sf_dir, "part"))))


def _options_sql(table: str) -> str:
    skip = ", ".join(f"'{x}'" for x in tg.OPTION_SKIP_NAMES)
    base = (f"SELECT c.pos, c.\"column\", p.dtype, p.unique_count, p.missing_count, {r('p.missing_count / p.n_rows')} AS missing_ratio, "
            f"{r('c.score')} AS score FROM ({_candidates_sql(table)}) c JOIN ({profile_sql(table)}) p USING (\"column\")")
    keep = (f"NOT p.is_id_like AND p.unique_count > 1 AND NOT coalesce(p.missing_count / p.n_rows > 0.8, false) "
            f"AND lower(c.\"column\") NOT IN ({skip})")
    fallback = (f"SELECT pos, \"column\", dtype, unique_count, missing_count, {r('missing_count / n_rows')} AS missing_ratio, 0.0 AS score, true AS fallback "
                f"FROM ({profile_sql(table)})")
    return (f"WITH k AS ({base} WHERE {keep}) SELECT *, false AS fallback FROM k "
            f"UNION ALL SELECT * FROM ({fallback}) WHERE NOT EXISTS (SELECT 1 FROM k)")


@register("target_options", _options_sql("part"))
def q_target_options(spark, sf_dir):
    return finish(tg.target_options(fx.table(spark, sf_dir, "part")))


@register("target_options_fallback",
          f"SELECT pos, \"column\", dtype, unique_count, missing_count, {r('missing_count / n_rows')} AS missing_ratio, 0.0 AS score, true AS fallback "
          f"FROM ({profile_sql('pages')})")
def q_target_options_fallback(spark, sf_dir):
    return finish(tg.target_options(fx.table(spark, sf_dir, "pages")))


def _infer_sql(table: str, c: str, fam: str) -> str:
    cls = f"(family = 'string' OR (family = 'numeric' AND unique_count <= least(20.0, 0.05 * n_rows)))"
    reg = "(family = 'numeric' AND unique_count / n_rows > 0.05)"
    if fam == "numeric":
        mom = (f"(SELECT avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
               f"skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM {table})")
    else:
        mom = "(SELECT NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis)"
    top = f"(SELECT max(cnt) AS top FROM (SELECT count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}))"
    prof = f"(SELECT * FROM ({profile_sql(table)}) WHERE \"column\" = '{c}')"
    maj = "top / n_rows"
    return (
        f"SELECT \"column\" AS target, CASE WHEN {cls} THEN 'classification' WHEN {reg} THEN 'regression' ELSE 'unclear' END AS task_type, "
        f"dtype AS target_dtype, unique_count AS unique_values, {r('unique_count / n_rows')} AS unique_ratio, missing_count, "
        f"{r('missing_count / n_rows')} AS missing_ratio, CASE WHEN {cls} THEN CASE WHEN unique_count = 2 THEN 'binary' ELSE 'multiclass' END END AS classification_type, "
        f"CASE WHEN {cls} THEN {r(maj)} END AS majority_ratio, "
        f"CASE WHEN {cls} THEN CASE WHEN {maj} > 0.9 THEN 'severely_imbalanced' WHEN {maj} > 0.7 THEN 'imbalanced' ELSE 'balanced' END END AS class_balance, "
        + ", ".join(f"CASE WHEN NOT {cls} AND {reg} THEN {r(x)} END AS {x}" for x in ["mean", "std", "min", "max", "skewness", "kurtosis"])
        + f", CASE WHEN NOT {cls} AND {reg} THEN CASE WHEN abs(skewness) > 2 THEN 'highly_skewed' WHEN abs(skewness) > 1 THEN 'moderately_skewed' "
        f"ELSE 'approximately_normal' END END AS distribution_note, "
        f"CASE WHEN NOT {cls} AND NOT {reg} THEN CASE WHEN unique_count / n_rows < 0.05 THEN 'classification' ELSE 'regression' END END AS hint "
        f"FROM {prof}, {top}, {mom}"
    )


@register("infer_task", fx.with_fixtures(_infer_sql("doc_labels", "quality", "numeric"), "doc_labels"))
def q_infer_task(spark, sf_dir):
    return finish(tg.infer_task(fx.doc_labels(spark, sf_dir), "quality"))


@register("infer_task_text", _infer_sql("orders", "o_orderpriority", "string"))
def q_infer_task_text(spark, sf_dir):
    return finish(tg.infer_task(fx.table(spark, sf_dir, "orders"), "o_orderpriority"))


@register("infer_task_regression", _infer_sql("orders", "o_totalprice", "numeric"))
def q_infer_task_regression(spark, sf_dir):
    return finish(tg.infer_task(fx.table(spark, sf_dir, "orders"), "o_totalprice"))


@register("infer_task_unclear", _infer_sql("lineitem", "l_quantity", "numeric"))
def q_infer_task_unclear(spark, sf_dir):
    return finish(tg.infer_task(fx.table(spark, sf_dir, "lineitem"), "l_quantity"))


@register("validate_target",
          "SELECT true AS valid, 'p_size' AS manual_target, t.task_type, c.recommended_target, c.recommended_target = 'p_size' AS matches_auto, "
          "t.missing_ratio > 0.3 AS warn_high_missing, (t.task_type = 'classification' AND t.class_balance = 'severely_imbalanced') AS recommend_rebalancing, "
          "(t.task_type = 'regression' AND t.distribution_note = 'highly_skewed') AS recommend_log_transform FROM ("
          + _infer_sql("part", "p_size", "numeric") + ") t, (SELECT \"column\" AS recommended_target FROM (" + _candidates_sql("part") + ") WHERE rank = 1) c")
def q_validate_target(spark, sf_dir):
    return finish(tg.validate_target(fx.table(spark, sf_dir, "part"), "p_size"))


def _basic_sql(table: str) -> str:
    n_cols = len([c for c, t in SCHEMAS[table] if family(t) != "other"])
    kw = " OR ".join(f"contains(lower(\"column\"), '{k}')" for k in tg.BASIC_KEYWORDS)
    ratio = "unique_count / n_rows"
    score = (f"(CASE WHEN {kw} THEN 30 ELSE 0 END + CASE WHEN family = 'string' AND {ratio} < 0.1 THEN 20 "
             f"WHEN family = 'numeric' AND {ratio} > 0.8 THEN 15 ELSE 0 END + CASE WHEN pos >= {n_cols - 3} THEN 10 ELSE 0 END)::DOUBLE")
    inner = (f"SELECT pos, \"column\", dtype, unique_count, {ratio} AS unique_ratio, missing_count, family, {score} AS score FROM ({profile_sql(table)})")
    ranked = f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank FROM ({inner})"
    top = "rank = 1 AND score > 20"
    return (f"SELECT pos, \"column\", dtype, unique_count, {r('unique_ratio')} AS unique_ratio, missing_count, score, rank, {top} AS recommended, "
            f"CASE WHEN {top} THEN least(score * 2, 100.0) END AS confidence, CASE WHEN {top} THEN CASE WHEN family = 'string' OR unique_ratio < 0.1 "
            f"THEN 'classification' ELSE 'regression' END END AS task_type FROM ({ranked})")


@register("target_candidates_basic", _basic_sql("orders"))
def q_target_candidates_basic(spark, sf_dir):
    return finish(tg.target_candidates_basic(fx.table(spark, sf_dir, "orders")))


@register("target_candidates_basic_part", _basic_sql("part"))
def q_target_candidates_basic_part(spark, sf_dir):
    return finish(tg.target_candidates_basic(fx.table(spark, sf_dir, "part")))


@register("target_profile",
          "SELECT count(DISTINCT o_orderpriority) AS unique_values, count(*) - count(o_orderpriority) AS missing_values, "
          + r("100.0 * (count(*) - count(o_orderpriority)) / count(*)") + " AS missing_percentage, 'string' AS data_type, "
          "(SELECT count(*) FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)) AS n_classes, "
          + r("(SELECT min(c) / max(c) FROM (SELECT count(*) AS c FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority))")
          + " AS class_balance_ratio, (SELECT min(c) / max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority)) < 0.3 AS flag_imbalance, "
          "(SELECT count(DISTINCT o_orderpriority) FROM orders) > 10 AS flag_many_classes, "
          "100.0 * (count(*) - count(o_orderpriority)) / count(*) > 5 AS flag_missing FROM orders")
def q_target_profile(spark, sf_dir):
    return finish(tg.target_profile(fx.table(spark, sf_dir, "orders"), "o_orderpriority", "classification"))


@register("target_profile_regression", fx.with_fixtures(
    "SELECT count(DISTINCT l_discount) AS unique_values, count(*) - count(l_discount) AS missing_values, "
    + r("100.0 * (count(*) - count(l_discount)) / count(*)") + " AS missing_percentage, 'double' AS data_type, "
    + r("avg(l_discount)") + " AS mean, " + r("stddev_samp(l_discount)") + " AS std, " + r("min(l_discount)") + " AS min, "
    + r("max(l_discount)") + " AS max, " + r("skewness(l_discount)") + " AS skewness, abs(skewness(l_discount)) > 1 AS flag_skewed, "
    "stddev_samp(l_discount) / avg(l_discount) > 1 AS flag_high_variance, 100.0 * (count(*) - count(l_discount)) / count(*) > 5 AS flag_missing "
    "FROM li_nulls", "li_nulls"))
def q_target_profile_regression(spark, sf_dir):
    return finish(tg.target_profile(fx.li_nulls(spark, sf_dir), "l_discount", "regression"))
