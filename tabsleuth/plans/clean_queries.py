"""Registered queries for cleanup (B) and quality findings."""

from __future__ import annotations

from ..functions import types as ty
from ..operators import clean as cl
from . import fixtures as fx
from .profile_queries import profile_sql
from .registry import finish, r, register
from .schemas import SCHEMAS, cols


@register("select_by_type", "SELECT " + ", ".join(cols("lineitem", "numeric")) + " FROM lineitem")
def q_select_by_type(spark, sf_dir):
    return finish(cl.select_by_type(fx.table(spark, sf_dir, "lineitem"), ty.NUMERIC))


@register("drop_constant_columns", fx.with_fixtures(
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal_copy FROM cust_const", "cust_const"))
def q_drop_constant_columns(spark, sf_dir):
    out, _ = cl.drop_constant_columns(fx.cust_const(spark, sf_dir))
    return finish(out)


@register("drop_duplicate_rows", fx.with_fixtures("SELECT DISTINCT * FROM cust_dup", "cust_dup"))
def q_drop_duplicate_rows(spark, sf_dir):
    return finish(cl.drop_duplicate_rows(fx.cust_dup(spark, sf_dir)))


@register("count_duplicate_rows", fx.with_fixtures(
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM cust_dup GROUP BY "
    + ", ".join(cols("cust_dup")) + ")", "cust_dup"))
def q_count_duplicate_rows(spark, sf_dir):
    return finish(cl.count_duplicate_rows(fx.cust_dup(spark, sf_dir)))


def _dup_cols_sql(table: str) -> str:
    sch = SCHEMAS[table]
    parts = []
    for i, (a, ta) in enumerate(sch):
        for b, tb in sch[i + 1:]:
            if ta == tb:
                parts.append(f"SELECT '{a}' AS column_1, '{b}' AS column_2 FROM {table} "
                             f"HAVING coalesce(bool_and({a} IS NOT DISTINCT FROM {b}), true)")
    return " UNION ALL ".join(parts)


@register("duplicate_columns", fx.with_fixtures(_dup_cols_sql("cust_const"), "cust_const"))
def q_duplicate_columns(spark, sf_dir):
    return finish(cl.duplicate_columns(fx.cust_const(spark, sf_dir)))


@register("filter_target_not_null", fx.with_fixtures("SELECT * FROM doc_labels WHERE quality IS NOT NULL", "doc_labels"))
def q_filter_target_not_null(spark, sf_dir):
    return finish(cl.filter_target_not_null(fx.doc_labels(spark, sf_dir), "quality"))


@register("pairwise_dropna", fx.with_fixtures(
    "SELECT l_discount, l_tax FROM li_nulls WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL", "li_nulls"))
def q_pairwise_dropna(spark, sf_dir):
    return finish(cl.pairwise_dropna(fx.li_nulls(spark, sf_dir), "l_discount", "l_tax"))


@register("drop_zero_variance", fx.with_fixtures(
    "SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal_copy FROM cust_const", "cust_const"))
def q_drop_zero_variance(spark, sf_dir):
    out, _ = cl.drop_zero_variance(fx.cust_const(spark, sf_dir))
    return finish(out)


_MODE_RF = ("(SELECT l_returnflag FROM li_nulls WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag "
            "ORDER BY count(*) DESC, l_returnflag LIMIT 1)")
_MED_DISC = "(SELECT quantile_cont(l_discount, 0.5) FROM li_nulls)"


@register("fill_median_mode", fx.with_fixtures(
    "SELECT " + ", ".join(
        f"coalesce(l_discount, {_MED_DISC}) AS l_discount" if c == "l_discount"
        else f"coalesce(l_returnflag, {_MODE_RF}) AS l_returnflag" if c == "l_returnflag" else c
        for c in cols("li_nulls")) + " FROM li_nulls", "li_nulls"))
def q_fill_median_mode(spark, sf_dir):
    return finish(cl.fill_median_mode(fx.li_nulls(spark, sf_dir)))


@register("fill_missing_label", fx.with_fixtures(
    "SELECT " + ", ".join(f"coalesce({c}, 'Missing') AS {c}" if c in ("l_returnflag", "l_linestatus") else c
                          for c in cols("li_nulls")) + " FROM li_nulls", "li_nulls"))
def q_fill_missing_label(spark, sf_dir):
    return finish(cl.fill_missing_label(fx.li_nulls(spark, sf_dir)))


def _codes(c: str) -> str:
    return (f"LEFT JOIN (SELECT v AS {c}_v, dense_rank() OVER (ORDER BY v) - 1 AS {c}_code FROM "
            f"(SELECT DISTINCT {c} AS v FROM li_nulls WHERE {c} IS NOT NULL)) ON t.{c} = {c}_v")


def _encoded(c: str) -> str:
    if c in ("l_returnflag", "l_linestatus"):
        return f"coalesce(CAST({c}_code AS DOUBLE), -1.0) AS {c}"
    if c == "l_discount":
        return f"{r(f'coalesce(t.l_discount, {_MED_DISC}, 0.0)')} AS l_discount"
    return f"t.{c}" if c == "l_shipdate" else f"{r(f't.{c}')} AS {c}"


@register("label_encode", fx.with_fixtures(
    f"SELECT {', '.join(_encoded(c) for c in cols('li_nulls'))} FROM li_nulls t {_codes('l_returnflag')} {_codes('l_linestatus')}", "li_nulls"))
def q_label_encode(spark, sf_dir):
    return finish(cl.label_encode(fx.li_nulls(spark, sf_dir)))


def _findings_sql(table: str) -> str:
    prof = f"({profile_sql(table)})"
    dup_rows = (f"SELECT 'duplicate_rows' AS \"check\", NULL::VARCHAR AS \"column\", CAST(d AS DOUBLE) AS value FROM "
                f"(SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(cols(table))})) WHERE d > 0")
    return (
        f"SELECT 'constant' AS \"check\", \"column\", CAST(unique_count AS DOUBLE) AS value FROM {prof} WHERE is_constant "
        f"UNION ALL SELECT 'high_missing', \"column\", missing_pct FROM {prof} WHERE missing_pct > 50 "
        f"UNION ALL SELECT 'id_like', \"column\", CAST(unique_count AS DOUBLE) FROM {prof} WHERE is_id_like "
        f"UNION ALL {dup_rows} "
        f"UNION ALL SELECT 'duplicate_column', column_1 || ',' || column_2, 1.0 FROM ({_dup_cols_sql(table)})"
    )


@register("quality_findings", fx.with_fixtures(_findings_sql("cust_const"), "cust_const"))
def q_quality_findings(spark, sf_dir):
    return finish(cl.quality_findings(fx.cust_const(spark, sf_dir)))


@register("quality_findings_dup", fx.with_fixtures(_findings_sql("cust_dup"), "cust_dup"))
def q_quality_findings_dup(spark, sf_dir):
    return finish(cl.quality_findings(fx.cust_dup(spark, sf_dir)))
