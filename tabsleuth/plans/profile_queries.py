"""Registered queries for scans (A) and the column profile (C)."""

from __future__ import annotations


from ..operators import profile as pr
from . import fixtures as fx
from .registry import finish, r, register
from .schemas import SCHEMAS, cols, family

# The oracle's own copy of the date pattern.
DATE_RE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def profile_sql(table: str) -> str:
    """Oracle for column_profile over ``table`` (a view or fixture CTE name)."""
    parts = []
    for i, (c, t) in enumerate(SCHEMAS[table]):
        fam = family(t)
        n, u, m = "count(*)", f"count(DISTINCT {c})", f"(count(*) - count({c}))"
        small = f"{u} <= least(50.0, 0.2 * {n})"
        if fam == "numeric":
            sem = f"CASE WHEN {small} AND {u} > 1 THEN 'categorical_numeric' ELSE 'numeric' END"
        elif fam == "string":
            dates = f"bool_and({c} IS NULL OR (regexp_full_match({c}, '{DATE_RE}') AND try_cast({c} AS TIMESTAMP) IS NOT NULL))"
            sem = f"CASE WHEN {dates} AND {u} > 0 THEN 'datetime' WHEN {u} > 0 AND {small} THEN 'categorical' ELSE 'text' END"
        elif fam == "datetime":
            sem = "'datetime'"
        else:
            sem = "'other'"
        mean_len = f"avg(length({c}))" if fam == "string" else "NULL"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS \"column\", '{t}' AS dtype, '{fam}' AS family, {n} AS n_rows, "
            f"{m} AS missing_count, {r(f'100.0 * {m} / {n}')} AS missing_pct, {u} AS unique_count, "
            f"{r(f'100.0 * {u} / {n}')} AS unique_pct, {u} <= 1 AS is_constant, "
            f"({u} > 0.95 * {n} AND {n} > 100) AS is_id_like, {sem} AS semantic_type, {r(mean_len)} AS mean_length "
            f"FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _profile(spark, sf_dir, name):
    return pr.column_profile(fx.load(spark, sf_dir, name))


# ------------------------------------------------------------------ A: scans

@register("read_parquet", "SELECT * FROM lineitem")
def q_read_parquet(spark, sf_dir):
    return finish(fx.table(spark, sf_dir, "lineitem"))


@register("row_cap", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def q_row_cap(spark, sf_dir):
    from ..sources import io

    return finish(io.row_cap(fx.table(spark, sf_dir, "orders"), 1000, order_by=["o_orderkey"]))


@register("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def q_preview(spark, sf_dir):
    from ..sources import io

    return finish(io.preview(fx.table(spark, sf_dir, "customer"), ["c_custkey"], 20))


# ------------------------------------------------------------------ C: profile

@register("dataset_overview", fx.with_fixtures(
    "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_cols, CAST(8 AS BIGINT) AS numeric_cols, "
    "CAST(2 AS BIGINT) AS categorical_cols, CAST(" + " + ".join(f"count(*) - count({c})" for c in cols("li_nulls")) +
    " AS BIGINT) AS missing_values, " +
    r("100.0 * (" + " + ".join(f"count(*) - count({c})" for c in cols("li_nulls")) + ") / (count(*) * 11)") +
    " AS missing_percentage FROM li_nulls", "li_nulls"))
def q_dataset_overview(spark, sf_dir):
    return finish(pr.dataset_overview(fx.li_nulls(spark, sf_dir)))


@register("column_info", fx.with_fixtures(
    "SELECT pos, \"column\", dtype AS type, missing_count AS missing, round(missing_pct, 2) AS missing_pct, "
    "unique_count AS \"unique\", unique_pct FROM (" + profile_sql("li_nulls") + ")", "li_nulls"))
def q_column_info(spark, sf_dir):
    return finish(pr.column_info(_profile(spark, sf_dir, "li_nulls")))


@register("infer_column_types", fx.with_fixtures(profile_sql("dates_as_text"), "dates_as_text"))
def q_infer_column_types(spark, sf_dir):
    return finish(_profile(spark, sf_dir, "dates_as_text"))


@register("infer_column_types_lineitem", fx.with_fixtures(profile_sql("li_nulls"), "li_nulls"))
def q_infer_column_types_lineitem(spark, sf_dir):
    return finish(_profile(spark, sf_dir, "li_nulls"))


@register("infer_column_types_documents", fx.with_fixtures(profile_sql("doc_labels"), "doc_labels"))
def q_infer_column_types_documents(spark, sf_dir):
    return finish(_profile(spark, sf_dir, "doc_labels"))


def _describe_sql(table: str) -> str:
    parts = []
    for c in cols(table, "numeric"):
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
            f"{r(f'min({c})')} AS \"min\", {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50, "
            f"{r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS \"max\" FROM {table}"
        )
    return " UNION ALL ".join(parts)


@register("describe_numeric", fx.with_fixtures(_describe_sql("li_nulls"), "li_nulls"))
def q_describe_numeric(spark, sf_dir):
    from ..operators.distributions import describe_numeric

    return finish(describe_numeric(fx.li_nulls(spark, sf_dir)))


@register("missing_summary", fx.with_fixtures(
    "SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing, count(*) FILTER (WHERE missing_count > 0) AS columns_with_missing, "
    + r("100.0 * sum(missing_count) / sum(n_rows)") + " AS missing_percentage FROM (" + profile_sql("doc_labels") + ")",
    "doc_labels"))
def q_missing_summary(spark, sf_dir):
    return finish(pr.missing_summary(pr.missing_table(fx.load(spark, sf_dir, "doc_labels"))))


@register("missing_by_column", fx.with_fixtures(
    "SELECT pos, \"column\", missing_count, missing_pct FROM (" + profile_sql("doc_labels") + ") WHERE missing_count > 0",
    "doc_labels"))
def q_missing_by_column(spark, sf_dir):
    return finish(pr.missing_by_column(pr.missing_table(fx.load(spark, sf_dir, "doc_labels")), only_missing=True))


@register("dtype_summary", "SELECT dtype, count(*) AS n_columns FROM (" + profile_sql("lineitem") + ") GROUP BY dtype")
def q_dtype_summary(spark, sf_dir):
    return finish(pr.dtype_summary(fx.table(spark, sf_dir, "lineitem")))


def _table_size_sql(table: str) -> str:
    widths = {"int": 4, "bigint": 8, "double": 8, "timestamp_ntz": 8, "float": 4}
    terms = []
    for c, t in SCHEMAS[table]:
        if t == "string":
            terms.append(f"coalesce(sum(strlen({c})), 0)")
        else:
            terms.append(f"count({c}) * {widths[t]}")
    total = " + ".join(terms)
    return (f"SELECT CAST({total} AS BIGINT) AS data_bytes, {r(f'({total}) / 1048576.0')} AS data_mb, "
            f"({total}) / 1048576.0 > 500 AS is_large FROM {table}")


@register("table_size", _table_size_sql("documents"))
def q_table_size(spark, sf_dir):
    return finish(pr.table_size(fx.table(spark, sf_dir, "documents")))


@register("high_missing_columns", fx.with_fixtures(
    "SELECT pos, \"column\", missing_count, missing_pct FROM (" + profile_sql("doc_labels") + ") WHERE missing_pct > 50",
    "doc_labels"))
def q_high_missing_columns(spark, sf_dir):
    return finish(pr.high_missing_columns(pr.missing_table(fx.load(spark, sf_dir, "doc_labels")), 50.0))


@register("id_like_columns", "SELECT pos, \"column\", unique_count, n_rows FROM (" + profile_sql("orders") + ") WHERE is_id_like")
def q_id_like_columns(spark, sf_dir):
    return finish(pr.id_like_columns(_profile(spark, sf_dir, "orders")))


@register("constant_columns", fx.with_fixtures(
    "SELECT pos, \"column\", unique_count FROM (" + profile_sql("cust_const") + ") WHERE is_constant", "cust_const"))
def q_constant_columns(spark, sf_dir):
    return finish(pr.constant_columns(_profile(spark, sf_dir, "cust_const")))


@register("high_cardinality_columns",
          "SELECT pos, \"column\", unique_count FROM (" + profile_sql("part") + ") WHERE family = 'string' AND unique_count > 50 AND NOT is_constant")
def q_high_cardinality_columns(spark, sf_dir):
    return finish(pr.high_cardinality_columns(_profile(spark, sf_dir, "part")))


def _outlier_sql(table: str, factor: float = 1.5) -> str:
    parts = []
    for c in cols(table, "numeric"):
        parts.append(
            f"SELECT '{c}' AS \"column\", q1, q3, q3 - q1 AS iqr, q1 - {factor} * (q3 - q1) AS lower_bound, "
            f"q3 + {factor} * (q3 - q1) AS upper_bound, n_out AS outlier_count, 100.0 * n_out / n AS outlier_pct FROM ("
            f"SELECT b.q1, b.q3, count(*) AS n, count(*) FILTER (WHERE t.{c} < b.q1 - {factor} * (b.q3 - b.q1) "
            f"OR t.{c} > b.q3 + {factor} * (b.q3 - b.q1)) AS n_out FROM {table} t, "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) b GROUP BY b.q1, b.q3)"
        )
    inner = " UNION ALL ".join(parts)
    return (f"SELECT \"column\", {r('q1')} AS q1, {r('q3')} AS q3, {r('iqr')} AS iqr, {r('lower_bound')} AS lower_bound, "
            f"{r('upper_bound')} AS upper_bound, outlier_count, {r('outlier_pct')} AS outlier_pct FROM ({inner})")


@register("outliers_iqr", _outlier_sql("events"))
def q_outliers_iqr(spark, sf_dir):
    return finish(pr.outliers_iqr(fx.table(spark, sf_dir, "events")))


@register("outlier_flags",
          "SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events, "
          "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)")
def q_outlier_flags(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    bounds = pr.outliers_iqr(ev, ["value"]).first()
    return finish(pr.flag_outliers(ev, "value", bounds).select("event_id", "is_outlier"))


def _stability_sql() -> str:
    t = "events"
    num = ["event_id", "user_id", "value"]
    other = ["ts", "event_type", "props"]
    parts = []
    for c in num:
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN avg(m) = 0 OR avg(m) IS NULL THEN 1.0 "
            f"ELSE greatest(0.0, 1 - stddev_pop(m) / abs(avg(m))) END AS stability "
            f"FROM (SELECT event_id % 10 AS rep, avg({c}) AS m FROM {t} GROUP BY 1)"
        )
    for c in other:
        parts.append(
            f"SELECT '{c}' AS \"column\", 1 - stddev_pop(share) AS stability FROM ("
            f"SELECT rep, coalesce(max(cnt) FILTER (WHERE v IS NOT NULL) / sum(cnt), 0.0) AS share FROM ("
            f"SELECT event_id % 10 AS rep, CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {t} GROUP BY 1, 2) GROUP BY rep)"
        )
    return f"SELECT \"column\", {r('stability')} AS stability FROM (" + " UNION ALL ".join(parts) + ")"


_SAMPLES = ("(SELECT * FROM (SELECT e.*, g.rep, row_number() OVER (PARTITION BY g.rep ORDER BY md5(CAST(event_id AS VARCHAR) || ':42:' || CAST(g.rep AS VARCHAR))) AS place "
            "FROM events e, (SELECT range AS rep FROM range(0, 10)) g) WHERE place <= 1000)")


@register("feature_stability_samples", _stability_sql().replace("event_id % 10 AS rep", "rep").replace("FROM events", f"FROM {_SAMPLES}"))
def q_feature_stability_samples(spark, sf_dir):
    """Ten samples of 1,000 rows."""
    ev = fx.table(spark, sf_dir, "events")
    return finish(pr.feature_stability(ev, "event_id", [c for c in ev.columns]))


@register("feature_stability", _stability_sql())
def q_feature_stability(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return finish(pr.feature_stability(ev, "event_id", [c for c in ev.columns], by_key_mod=True))
