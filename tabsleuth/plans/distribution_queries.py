"""Registered queries for distributions."""

from __future__ import annotations

from ..operators import distributions as ds
from ..operators import profile as pr
from . import fixtures as fx
from .registry import finish, r, register
from .schemas import SCHEMAS, cols


def _hist_sql(table: str, columns: list[str], bins: int) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(g.bin AS INTEGER) AS bin, {r(f'rr.lo + g.bin * (rr.hi - rr.lo) / {bins}')} AS bin_start, "
            f"{r(f'rr.lo + (g.bin + 1) * (rr.hi - rr.lo) / {bins}')} AS bin_end, CAST(coalesce(k.cnt, 0) AS BIGINT) AS \"count\" "
            f"FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) rr CROSS JOIN (SELECT range AS bin FROM range(0, {bins})) g "
            f"LEFT JOIN (SELECT CASE WHEN q.hi = q.lo THEN 0 ELSE least(floor((t.{c} - q.lo) / (q.hi - q.lo) * {bins}), {bins - 1}) END AS b, "
            f"count(*) AS cnt FROM {table} t, (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) q WHERE t.{c} IS NOT NULL GROUP BY 1) k "
            f"ON k.b = g.bin WHERE rr.lo IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


@register("histogram", _hist_sql("events", ["event_id", "user_id", "value"], 20))
def q_histogram(spark, sf_dir):
    return finish(ds.histogram(fx.table(spark, sf_dir, "events"), bins=20))


@register("histogram_lineitem", fx.with_fixtures(_hist_sql("li_nulls", cols("li_nulls", "numeric"), 10), "li_nulls"))
def q_histogram_lineitem(spark, sf_dir):
    return finish(ds.histogram(fx.li_nulls(spark, sf_dir), bins=10))


def _auto_hist_sql(table: str, columns: list[str]) -> str:
    """Bins by the narrower of 2 IQR / n^(1/3) and range / (log2 n + 1)."""
    parts = []
    for c in columns:
        width = "least((hi - lo) / (log2(n) + 1), 2 * (q3 - q1) / pow(n, 1.0 / 3))"
        stats = (f"(SELECT lo, hi, CAST(ceil((hi - lo) / {width}) AS BIGINT) AS bins FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count({c})::DOUBLE AS n, "
                 f"quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table}))")
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(g.bin AS INTEGER) AS bin, {r('s.lo + g.bin * (s.hi - s.lo) / s.bins')} AS bin_start, "
            f"{r('s.lo + (g.bin + 1) * (s.hi - s.lo) / s.bins')} AS bin_end, CAST(coalesce(k.cnt, 0) AS BIGINT) AS \"count\" "
            f"FROM {stats} s JOIN (SELECT range AS bin FROM range(0, 10000)) g ON g.bin < s.bins "
            f"LEFT JOIN (SELECT CAST(least(floor((t.{c} - q.lo) / (q.hi - q.lo) * q.bins), q.bins - 1) AS BIGINT) AS b, count(*) AS cnt FROM {table} t, {stats} q "
            f"WHERE t.{c} IS NOT NULL GROUP BY 1) k ON k.b = g.bin"
        )
    return " UNION ALL ".join(parts)


@register("histogram_auto", _auto_hist_sql("events", ["user_id", "value"]))
def q_histogram_auto(spark, sf_dir):
    return finish(ds.histogram(fx.table(spark, sf_dir, "events"), ["user_id", "value"], bins="auto"))


def _topk_sql(table: str, k: int, max_unique: int | None) -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS \"count\" FROM {table} "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c, t in SCHEMAS[table] if t not in ("timestamp_ntz",)]
    freq = " UNION ALL ".join(parts)
    keep = f"WHERE \"column\" IN (SELECT \"column\" FROM f GROUP BY 1 HAVING count(*) <= {max_unique})" if max_unique else ""
    return (f"WITH f AS ({freq}) SELECT \"column\", CAST(rk AS INTEGER) AS rank, value, \"count\" FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY \"count\" DESC, value) AS rk FROM f {keep}) WHERE rk <= {k}")


@register("value_counts_topk", _topk_sql("orders", 10, 20))
def q_value_counts_topk(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    freq = pr.frequency_table(o)
    return finish(ds.value_counts_topk(freq, k=10, max_unique=20))


@register("value_counts_top20", _topk_sql("part", 20, None))
def q_value_counts_top20(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    freq = pr.frequency_table(p)
    return finish(ds.value_counts_topk(freq, k=20, max_unique=None))


def _box_sql(table: str, columns: list[str], factor: float = 1.5) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS \"column\", q1, med AS median, q3, q1 - {factor} * (q3 - q1) AS lower_fence, q3 + {factor} * (q3 - q1) AS upper_fence, "
            f"min(t.{c}) FILTER (WHERE t.{c} >= q1 - {factor} * (q3 - q1) AND t.{c} <= q3 + {factor} * (q3 - q1)) AS whisker_low, "
            f"max(t.{c}) FILTER (WHERE t.{c} >= q1 - {factor} * (q3 - q1) AND t.{c} <= q3 + {factor} * (q3 - q1)) AS whisker_high, "
            f"count(*) FILTER (WHERE t.{c} < q1 - {factor} * (q3 - q1) OR t.{c} > q3 + {factor} * (q3 - q1)) AS outlier_count "
            f"FROM {table} t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {table}) "
            f"WHERE t.{c} IS NOT NULL GROUP BY q1, med, q3"
        )
    inner = " UNION ALL ".join(parts)
    outs = ", ".join(f"{r(x)} AS {x}" for x in ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"])
    return f"SELECT \"column\", {outs}, outlier_count FROM ({inner})"


@register("box_stats", _box_sql("events", ["event_id", "user_id", "value"]))
def q_box_stats(spark, sf_dir):
    return finish(ds.box_stats(fx.table(spark, sf_dir, "events")))


@register("scatter_points", "SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def q_scatter_points(spark, sf_dir):
    return finish(ds.scatter_points(fx.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


def _shape_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis FROM {table}"
        for c in cols(table, "numeric")
    )


@register("shape_stats", fx.with_fixtures(_shape_sql("li_nulls"), "li_nulls"))
def q_shape_stats(spark, sf_dir):
    return finish(ds.shape_stats(fx.li_nulls(spark, sf_dir)))


@register("shape_stats_events", _shape_sql("events"))
def q_shape_stats_events(spark, sf_dir):
    return finish(ds.shape_stats(fx.table(spark, sf_dir, "events")))


@register("class_distribution",
          "SELECT o_orderpriority AS class, count(*) AS \"count\", "
          + r("count(*) / sum(count(*)) OVER ()") + " AS share FROM orders GROUP BY 1")
def q_class_distribution(spark, sf_dir):
    return finish(ds.class_distribution(fx.table(spark, sf_dir, "orders"), "o_orderpriority"))


def _balance_sql(table: str, c: str) -> str:
    return (
        f"SELECT n_classes, {r('mx / n')} AS majority_ratio, CASE WHEN mx / n > 0.9 THEN 'severely_imbalanced' "
        f"WHEN mx / n > 0.7 THEN 'imbalanced' ELSE 'balanced' END AS class_balance, "
        f"{r('coalesce(mn / mx, 1.0)')} AS balance_ratio, coalesce(mn / mx, 1.0) < 0.3 AS imbalance_flag, "
        f"n_classes > 10 AS many_classes_flag, mx / nl > 0.8 AS dominant_class_flag FROM ("
        f"SELECT count(*) FILTER (WHERE k IS NOT NULL) AS n_classes, sum(cnt) AS n, "
        f"max(cnt) FILTER (WHERE k IS NOT NULL) AS mx, min(cnt) FILTER (WHERE k IS NOT NULL) AS mn, "
        f"sum(cnt) FILTER (WHERE k IS NOT NULL) AS nl FROM (SELECT {c} AS k, count(*) AS cnt FROM {table} GROUP BY 1))"
    )


@register("class_balance", fx.with_fixtures(_balance_sql("doc_labels", "quality"), "doc_labels"))
def q_class_balance(spark, sf_dir):
    return finish(ds.class_balance(fx.doc_labels(spark, sf_dir), "quality"))


@register("class_balance_multi", _balance_sql("part", "p_brand"))
def q_class_balance_multi(spark, sf_dir):
    return finish(ds.class_balance(fx.table(spark, sf_dir, "part"), "p_brand"))
