"""Registered queries for relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as ds
from ..operators import relations as rl
from . import fixtures as fx
from .registry import finish, r, register
from .schemas import cols


def _pairs(cs):
    return [(a, b) for i, a in enumerate(cs) for b in cs[i + 1:]]


def _pearson_sql(table: str, cs: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {r(f'corr({a}, {b})')} AS value FROM {table}" for a, b in _pairs(cs))


LI_NUM = cols("lineitem", "numeric")


def _components(spark, sf_dir):
    """The embeddings as a wide table: one column a component."""
    e = fx.table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    return e.select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(width)])


@register("pearson_wide",
          "WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) "
          f"SELECT 'c' || a.i AS var1, 'c' || b.i AS var2, {r('corr(a.v, b.v)')} AS value FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i")
def q_pearson_wide(spark, sf_dir):
    """All pairs of the components of the embeddings, from one scan."""
    return finish(rl.pearson(_components(spark, sf_dir)))


@register("vif_wide")
def q_vif_wide(spark, sf_dir):
    return finish(rl.vif(_components(spark, sf_dir)))


@register("pearson", fx.with_fixtures(_pearson_sql("li_nulls", LI_NUM), "li_nulls"))
def q_pearson(spark, sf_dir):
    return finish(rl.pearson(fx.li_nulls(spark, sf_dir)))


CUST_NUM = cols("cust_const", "numeric")


@register("strong_pairs", fx.with_fixtures(
    "SELECT var1 AS feature_1, var2 AS feature_2, value AS correlation, abs(value) AS abs_correlation, "
    "CASE WHEN abs(value) >= 0.9 THEN 'Very Strong' ELSE 'Strong' END AS strength FROM ("
    + _pearson_sql("cust_const", CUST_NUM) + ") WHERE abs(value) >= 0.7 AND NOT isnan(value)", "cust_const"))
def q_strong_pairs(spark, sf_dir):
    return finish(rl.strong_pairs(rl.pearson(fx.cust_const(spark, sf_dir))))


def _spearman_sql(table: str, cs: list[str]) -> str:
    parts = []
    for a, b in _pairs(cs):
        parts.append(
            f"SELECT '{a}' AS var1, '{b}' AS var2, {r('corr(ra, rb)')} AS value FROM (SELECT "
            f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
            f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        )
    return " UNION ALL ".join(parts)


@register("spearman", fx.with_fixtures(_spearman_sql("li_nulls", LI_NUM), "li_nulls"))
def q_spearman(spark, sf_dir):
    return finish(rl.spearman(fx.li_nulls(spark, sf_dir)))


@register("spearman_orders", _spearman_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_spearman_orders(spark, sf_dir):
    return finish(rl.spearman(fx.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]))


def _kendall_sql(table: str, pairs: list[tuple[str, str]]) -> str:
    parts = []
    for a, b in pairs:
        cells = f"SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2"
        parts.append(
            f"SELECT '{a}' AS var1, '{b}' AS var2, {r('s / sqrt((n0 - n1) * (n0 - n2))')} AS value FROM ("
            f"SELECT (SELECT sum(c1.w * c2.w * sign(c1.x - c2.x) * sign(c1.y - c2.y)) FROM ({cells}) c1, ({cells}) c2 WHERE c1.x < c2.x) AS s, "
            f"(SELECT sum(w) * (sum(w) - 1) / 2 FROM ({cells})) AS n0, "
            f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM ({cells}) GROUP BY x)) AS n1, "
            f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM ({cells}) GROUP BY y)) AS n2)"
        )
    return " UNION ALL ".join(parts)


KENDALL_PAIRS = [("l_quantity", "l_discount"), ("l_linenumber", "l_tax"), ("l_quantity", "l_linenumber")]


@register("kendall", fx.with_fixtures(_kendall_sql("li_nulls", KENDALL_PAIRS), "li_nulls"))
def q_kendall(spark, sf_dir):
    return finish(rl.kendall_pairs(fx.li_nulls(spark, sf_dir), KENDALL_PAIRS))


@register("kendall_matrix_lineitem")
def q_kendall_matrix_lineitem(spark, sf_dir):
    """All 28 numeric pairs; DuckDB would need all row pairs."""
    return finish(rl.kendall_matrix(fx.table(spark, sf_dir, "lineitem")))


@register("kendall_matrix_part", _kendall_sql("part", _pairs(cols("part", "numeric"))))
def q_kendall_matrix_part(spark, sf_dir):
    return finish(rl.kendall_matrix(fx.table(spark, sf_dir, "part")))


@register("kendall_matrix_supplier", _kendall_sql("supplier", _pairs(cols("supplier", "numeric"))))
def q_kendall_matrix_supplier(spark, sf_dir):
    return finish(rl.kendall_matrix(fx.table(spark, sf_dir, "supplier")))


def _chi2_sql(table: str, a: str, b: str, missing: bool = False) -> str:
    va = f"coalesce(CAST({a} AS VARCHAR), 'Missing')" if missing else f"CAST({a} AS VARCHAR)"
    vb = f"coalesce(CAST({b} AS VARCHAR), 'Missing')" if missing else f"CAST({b} AS VARCHAR)"
    base = f"SELECT {va} AS a, {vb} AS b FROM {table}"
    comp = f"SELECT * FROM ({base}) WHERE a IS NOT NULL AND b IS NOT NULL"
    return (
        f"SELECT '{a}' AS var1, '{b}' AS var2, sum(CASE WHEN r = 2 AND c = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e "
        f"ELSE pow(o - e, 2) / e END) AS chi2, max(n) AS n, max(r) AS r, max(c) AS c FROM ("
        f"SELECT coalesce(k.o, 0) AS o, ra.t * cb.t / tot.n AS e, tot.n, tot.r, tot.c FROM "
        f"(SELECT a, count(*) AS t FROM ({comp}) GROUP BY a) ra CROSS JOIN (SELECT b, count(*) AS t FROM ({comp}) GROUP BY b) cb "
        f"CROSS JOIN (SELECT count(*) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM ({comp})) tot "
        f"LEFT JOIN (SELECT a, b, count(*) AS o FROM ({comp}) GROUP BY a, b) k ON k.a = ra.a AND k.b = cb.b)"
    )


def _cramer_sql(table: str, pairs, missing: bool = False) -> str:
    inner = " UNION ALL ".join(_chi2_sql(table, a, b, missing) for a, b in pairs)
    return (f"SELECT var1, var2, {r('CASE WHEN least(r, c) - 1 <= 0 THEN 0.0 ELSE sqrt(chi2 / (n * (least(r, c) - 1))) END')} AS value "
            f"FROM ({inner})")


@register("cramers_v", fx.with_fixtures(_cramer_sql("li_2x2", [("l_returnflag", "l_linestatus")]), "li_2x2"))
def q_cramers_v(spark, sf_dir):
    return finish(rl.cramers_v(fx.li_2x2(spark, sf_dir), "l_returnflag", "l_linestatus"))


PART_CAT = cols("part", "string")


@register("cramers_v_matrix", _cramer_sql("part", _pairs(PART_CAT)))
def q_cramers_v_matrix(spark, sf_dir):
    return finish(rl.cramers_v_matrix(fx.table(spark, sf_dir, "part")))


@register("cramers_v_matrix_missing", fx.with_fixtures(_cramer_sql("li_nulls", [("l_returnflag", "l_linestatus")], missing=True), "li_nulls"))
def q_cramers_v_matrix_missing(spark, sf_dir):
    return finish(rl.cramers_v_matrix(fx.li_nulls(spark, sf_dir), missing_label="Missing"))


@register("cramers_v_lineitem", _cramer_sql("lineitem", [("l_returnflag", "l_linestatus")]))
def q_cramers_v_lineitem(spark, sf_dir):
    return finish(rl.cramers_v_matrix(fx.table(spark, sf_dir, "lineitem")))


_MAKER = "part_maker AS (SELECT *, substr(p_brand, 1, 7) AS p_maker FROM part)"


@register("strong_associations",
          f"WITH {_MAKER} SELECT var1 AS variable_1, var2 AS variable_2, value AS cramers_v, CASE WHEN value >= 0.8 THEN 'Very Strong' ELSE 'Strong' END AS strength "
          "FROM (" + _cramer_sql("part_maker", _pairs([*PART_CAT, "p_maker"])) + ") WHERE value >= 0.5")
def q_strong_associations(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return finish(rl.strong_associations(rl.cramers_v_matrix(p.withColumn("p_maker", p["p_brand"].substr(1, 7)))))


@register("chi_square_test", fx.with_fixtures(
    "SELECT var1, var2, " + r("chi2") + " AS chi2, (r - 1) * (c - 1) AS dof, n FROM ("
    + " UNION ALL ".join([_chi2_sql("li_2x2", "l_returnflag", "l_linestatus")] + [_chi2_sql("orders", "o_orderstatus", "o_orderpriority")]) + ")",
    "li_2x2"))
def q_chi_square_test(spark, sf_dir):
    a = rl.chi_square_test(fx.li_2x2(spark, sf_dir), ["l_returnflag", "l_linestatus"])
    b = rl.chi_square_test(fx.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return finish(a.unionByName(b))


@register("chi_square_pvalues")
def q_chi_square_pvalues(spark, sf_dir):
    return finish(rl.chi_square_test(fx.table(spark, sf_dir, "part"), with_p=True))


def _anova_inner(table: str, num: list[str], cat: list[str]) -> str:
    parts = []
    for nm in num:
        for c in cat:
            comp = f"SELECT {nm} AS x, {c} AS g FROM {table} WHERE {nm} IS NOT NULL AND {c} IS NOT NULL"
            parts.append(
                f"SELECT '{nm}' AS numeric_variable, '{c}' AS categorical_variable, N, k, ssb, ssw FROM ("
                f"SELECT count(*) AS N, count(DISTINCT g) AS k, sum(pow(gm - tm, 2)) AS ssb, sum(pow(x - gm, 2)) AS ssw FROM ("
                f"SELECT x, g, avg(x) OVER (PARTITION BY g) AS gm, avg(x) OVER () AS tm FROM ({comp})))"
            )
    return " UNION ALL ".join(parts)


def _anova_sql(table: str, num: list[str], cat: list[str]) -> str:
    return (f"SELECT numeric_variable, categorical_variable, {r('(ssb / (k - 1)) / (ssw / (N - k))')} AS f_statistic "
            f"FROM ({_anova_inner(table, num, cat)}) WHERE N >= 10 AND k >= 2")


@register("anova_f", fx.with_fixtures(_anova_sql("li_nulls", LI_NUM, ["l_returnflag", "l_linestatus"]), "li_nulls"))
def q_anova_f(spark, sf_dir):
    return finish(rl.anova_f(fx.li_nulls(spark, sf_dir), with_p=False))


ORDER_NUM, ORDER_CAT = cols("orders", "numeric"), cols("orders", "string")


@register("anova_f_orders", _anova_sql("orders", ORDER_NUM, ORDER_CAT))
def q_anova_f_orders(spark, sf_dir):
    return finish(rl.anova_f(fx.table(spark, sf_dir, "orders"), with_p=False))


def _anova_p_sql(num: list[str]) -> str:
    """P-values in closed form: with an even number 2m of numerator degrees the
    tail of F is x^(d/2) * sum over j < m of (d/2)_j (1-x)^j / j!, x = d / (d + 2m F)."""
    parts = []
    for c, k in (("o_orderstatus", 3), ("o_orderpriority", 5)):
        x = f"(d / (d + {k - 1} * f))"
        tail = f"pow({x}, d / 2)" + (f" * (1 + d / 2 * (1 - {x}))" if k == 5 else "")
        parts.append(f"SELECT numeric_variable, categorical_variable, f AS f_statistic, {tail} AS p FROM (SELECT numeric_variable, categorical_variable, "
                     f"(ssb / {k - 1}) / (ssw / (N - {k})) AS f, (N - {k})::DOUBLE AS d FROM (" + _anova_inner("orders", num, [c]) + "))")
    return " UNION ALL ".join(parts)


@register("anova_pvalues", f"SELECT numeric_variable, categorical_variable, {r('f_statistic')} AS f_statistic, {r('p')} AS p_value, p < 0.05 AS significant FROM ({_anova_p_sql(ORDER_NUM)})")
def q_anova_pvalues(spark, sf_dir):
    return finish(rl.anova_f(fx.table(spark, sf_dir, "orders"), with_p=True))


def _pb_sql(table: str, num: list[str], cat: list[str]) -> str:
    parts = []
    for c in cat:
        for nm in num:
            parts.append(
                f"SELECT '{nm}' AS numeric_variable, '{c}' AS categorical_variable, "
                f"{r(f'corr(CASE WHEN {c} IS NULL THEN NULL WHEN {c} = (SELECT max({c}) FROM {table}) THEN 1.0 ELSE 0.0 END, {nm})')} AS correlation FROM {table}"
            )
    return " UNION ALL ".join(parts)


@register("point_biserial", fx.with_fixtures(_pb_sql("li_2x2", LI_NUM, ["l_returnflag", "l_linestatus"]), "li_2x2"))
def q_point_biserial(spark, sf_dir):
    return finish(rl.point_biserial(fx.li_2x2(spark, sf_dir)))


# ---------------------------------------------------------------- MI

MI_COLS = cols("li_nulls")
MI_NUM = [*LI_NUM, "l_shipdate"]
_LI_EPOCH = "(SELECT * REPLACE (epoch_us(l_shipdate) / 1e6 AS l_shipdate) FROM li_nulls)"


def _disc_sql(table: str, cs: list[str], num: list[str], raw: list[str] = ()) -> str:
    """Median/mode-filled, decile-binned view of ``cs``."""
    fill = []
    for c in cs:
        if c in num:
            fill.append(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {table})) AS {c}")
        else:
            fill.append(f"coalesce({c}, (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}")
    filled = f"(SELECT {', '.join(fill)} FROM {table})"
    sel = []
    for c in cs:
        if c in num and c not in raw:
            terms = " + ".join(f"CASE WHEN f.{c} > (SELECT quantile_cont({c}, {i / 10}) FROM {filled}) THEN 1 ELSE 0 END" for i in range(1, 10))
            sel.append(f"CAST({terms} AS VARCHAR) AS {c}")
        else:
            sel.append(f"CAST(f.{c} AS VARCHAR) AS {c}")
    return f"SELECT {', '.join(sel)} FROM {filled} f"


def _mi_sql(view: str, pairs) -> str:
    parts = []
    for a, b in pairs:
        parts.append(
            f"SELECT '{a}' AS var1, '{b}' AS var2, greatest(sum(o / n * ln(o * n / (ra * cb))), 0.0) AS value FROM ("
            f"SELECT count(*) AS o, max(ra) AS ra, max(cb) AS cb, max(n) AS n FROM (SELECT {a} AS a, {b} AS b, "
            f"count(*) OVER (PARTITION BY {a}) AS ra, count(*) OVER (PARTITION BY {b}) AS cb, count(*) OVER () AS n FROM {view}) GROUP BY a, b)"
        )
    return " UNION ALL ".join(parts)


_MI_VIEW = "WITH d AS MATERIALIZED (" + _disc_sql(_LI_EPOCH, MI_COLS, MI_NUM) + ") "


@register("pairwise_mi", fx.with_fixtures(
    _MI_VIEW + f"SELECT var1, var2, {r('value')} AS value FROM (" + _mi_sql("d", _pairs(MI_COLS)) + ")", "li_nulls").replace(") WITH d AS", "), d AS", 1))
def q_pairwise_mi(spark, sf_dir):
    return finish(rl.pairwise_mi(fx.li_nulls(spark, sf_dir)))


@register("top_mi_pairs", fx.with_fixtures(
    _MI_VIEW + f"SELECT var1, var2, {r('value')} AS value FROM (" + _mi_sql("d", _pairs(MI_COLS))
    + ") ORDER BY round(value, 6) DESC, var1, var2 LIMIT 10", "li_nulls").replace(") WITH d AS", "), d AS", 1))
def q_top_mi_pairs(spark, sf_dir):
    mi = finish(rl.pairwise_mi(fx.li_nulls(spark, sf_dir)))
    return rl.top_mi_pairs(mi, 10)


MI_T_FEATS = [c for c in MI_COLS if c not in ("l_returnflag", "l_shipdate")]


@register("mi_to_target", fx.with_fixtures(
    "WITH d AS MATERIALIZED (" + _disc_sql("li_nulls", MI_T_FEATS + ["l_returnflag"], MI_NUM) + ") "
    + f"SELECT var1 AS feature, {r('value')} AS mi, 'classification' AS task FROM ("
    + _mi_sql("d", [(f, "l_returnflag") for f in MI_T_FEATS]) + ")", "li_nulls").replace(") WITH d AS", "), d AS", 1))
def q_mi_to_target(spark, sf_dir):
    return finish(rl.mi_to_target(fx.li_nulls(spark, sf_dir), "l_returnflag"))


MI_ORDER_FEATS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register("mi_to_target_regression",
          "WITH d AS MATERIALIZED (" + _disc_sql("orders", [*MI_ORDER_FEATS, "o_totalprice"], ["o_orderkey", "o_custkey", "o_totalprice"]) + ") "
          + f"SELECT var1 AS feature, {r('value')} AS mi, 'regression' AS task FROM ("
          + _mi_sql("d", [(f, "o_totalprice") for f in MI_ORDER_FEATS]) + ")")
def q_mi_to_target_regression(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return finish(rl.mi_to_target(o, "o_totalprice"))


# ---------------------------------------------------------------- VIF

VIF_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _vif3_sql(table: str, cs: list[str]) -> str:
    med = {c: f"(SELECT quantile_cont({c}, 0.5) FROM {table})" for c in cs}
    x = {c: f"coalesce({c}, {med[c]})" for c in cs}
    g = {}
    for i, a in enumerate(cs):
        for j, b in enumerate(cs):
            if j >= i:
                g[(i, j)] = g[(j, i)] = f"g{i}{j}"
    sums = ", ".join(f"sum({x[a]} * {x[b]}) AS g{i}{j}" for i, a in enumerate(cs) for j, b in enumerate(cs) if j >= i)
    G = lambda i, j: g[(i, j)]
    det = (f"({G(0,0)} * ({G(1,1)} * {G(2,2)} - {G(1,2)} * {G(1,2)}) - {G(0,1)} * ({G(0,1)} * {G(2,2)} - {G(1,2)} * {G(0,2)}) "
           f"+ {G(0,2)} * ({G(0,1)} * {G(1,2)} - {G(1,1)} * {G(0,2)}))")
    cof = [f"({G(1,1)} * {G(2,2)} - {G(1,2)} * {G(1,2)})", f"({G(0,0)} * {G(2,2)} - {G(0,2)} * {G(0,2)})", f"({G(0,0)} * {G(1,1)} - {G(0,1)} * {G(0,1)})"]
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {G(i, i)} * {cof[i]} / {det} AS vif FROM s" for i, c in enumerate(cs))
    return f"WITH s AS (SELECT {sums} FROM {table}) SELECT feature, {r('vif')} AS vif FROM ({rows})"


@register("vif", fx.with_fixtures(_vif3_sql("li_nulls", VIF_COLS), "li_nulls").replace(") WITH s AS", "), s AS"))
def q_vif(spark, sf_dir):
    return finish(rl.vif(fx.li_nulls(spark, sf_dir), VIF_COLS))


@register("vif_lineitem")
def q_vif_lineitem(spark, sf_dir):
    return finish(rl.vif(fx.li_nulls(spark, sf_dir)))


@register("vif_orders", _vif3_sql("orders", ORDER_NUM))
def q_vif_orders(spark, sf_dir):
    return finish(rl.vif(fx.table(spark, sf_dir, "orders")))


@register("multicollinear_columns", fx.with_fixtures(
    "SELECT feature, 'inf'::DOUBLE AS vif FROM (VALUES ('c_acctbal'), ('c_acctbal_copy')) t(feature) "
    "WHERE (SELECT count_if(c_acctbal <> c_acctbal_copy) FROM cust_const) = 0", "cust_const"))
def q_multicollinear_columns(spark, sf_dir):
    return finish(rl.multicollinear_columns(rl.vif(fx.cust_const(spark, sf_dir))))


def _summary_sql() -> str:
    strong = lambda sql, least: f"(SELECT count(*)::DOUBLE FROM ({sql}) WHERE abs(value) >= {least} AND NOT isnan(value))"
    items = [
        ("total_features", "6.0"), ("numeric_features", "3.0"), ("categorical_features", "2.0"),
        ("strong_pearson", strong(_pearson_sql("orders", ORDER_NUM), 0.7)), ("strong_spearman", strong(_spearman_sql("orders", ORDER_NUM), 0.7)),
        ("high_vif", f"(SELECT count(*)::DOUBLE FROM ({_vif3_sql('orders', ORDER_NUM)}) WHERE vif > 10)"),
        ("strong_associations", strong(_cramer_sql("orders", _pairs(ORDER_CAT)), 0.5)),
        ("significant_anova", f"(SELECT count(*)::DOUBLE FROM ({_anova_p_sql(ORDER_NUM)}) WHERE p < 0.05)"),
    ]
    return " UNION ALL ".join(f"SELECT '{k}' AS item, {v} AS value" for k, v in items)


@register("relationship_summary", _summary_sql())
def q_relationship_summary(spark, sf_dir):
    return finish(rl.relationship_summary(fx.table(spark, sf_dir, "orders")))


@register("heatmap_long",
          "SELECT var1, var2, value FROM (" + _pearson_sql("lineitem", LI_NUM) + ") UNION ALL "
          "SELECT var2, var1, value FROM (" + _pearson_sql("lineitem", LI_NUM) + ") UNION ALL "
          + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in LI_NUM))
def q_heatmap_long(spark, sf_dir):
    return finish(ds.heatmap_long(finish(rl.pearson(fx.table(spark, sf_dir, "lineitem"))), LI_NUM))
