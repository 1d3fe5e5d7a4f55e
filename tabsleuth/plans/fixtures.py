"""Defect fixtures derived from the test tables.

The test tables are clean by construction (no null, NaN, constant column or
duplicate row), so defects are derived - identically - by a Spark builder
here and by a SQL common-table expression for the DuckDB oracle. Each
fixture is computed from the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- Spark side

def li_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with l_discount = 0 turned into NULL, and l_returnflag NULL on
    the same rows (numeric and categorical gaps)."""
    li = table(spark, sf_dir, "lineitem")
    zero = F.col("l_discount") == 0.0
    return li.select(
        *[
            F.when(zero, F.lit(None).cast(li.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in ("l_discount", "l_returnflag")
            else F.col(c)
            for c in li.columns
        ]
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lb = table(spark, sf_dir, "labels")
    return d.join(lb, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def cust_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (
        c.withColumn("c_const", F.lit("X"))
        .withColumn("c_acctbal_copy", F.col("c_acctbal"))
        .withColumn("c_zero", F.lit(0.0))
    )


def cust_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.unionByName(c.where(F.col("c_custkey") < 100))


def li_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "N")


def dates_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def pred_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    score = F.col("o_totalprice") / 500000.0
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        (score > 0.5).cast("int").alias("y_pred"),
        score.alias("score"),
    )


PRED_MULTI_CLASSES = ["A", "N", "R"]


def pred_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = l_returnflag, prediction by l_quantity thirds, one probability per class."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    pa = F.when(q <= 17, 0.6).when(q <= 34, 0.2).otherwise(0.2)
    pn = F.when(q <= 17, 0.25).when(q <= 34, 0.5).otherwise(0.25)
    pr = F.lit(1.0) - pa - pn
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("y_true"),
        F.when(q <= 17, "A").when(q <= 34, "N").otherwise("R").alias("y_pred"),
        pa.alias("p_A"),
        pn.alias("p_N"),
        pr.alias("p_R"),
    )


def pred_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * 1500.0).alias("y_pred"),
        F.col("l_discount").alias("y_small"),
        (F.col("l_tax") + 0.01).alias("y_small_pred"),
    )


def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fold-score table (run, model, fold, metric, value) derived from
    orders: one run per order priority, one 'model' per order status."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(
        F.col("o_orderpriority").alias("run"),
        F.col("o_orderstatus").alias("model"),
        F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int").alias("fold"),
    ).agg((F.avg("o_totalprice") / 500000.0).alias("value"))
    return g.withColumn("metric", F.lit("balanced_accuracy")).select("run", "model", "fold", "metric", "value")


IMPORTANCE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, feature, importance): |corr| of line columns with l_extendedprice,
    one run per return flag."""
    li = table(spark, sf_dir, "lineitem")
    aggs = [F.abs(F.corr(F.col(f).cast("double"), "l_extendedprice")).alias(f) for f in IMPORTANCE_FEATURES]
    wide = li.groupBy(F.col("l_returnflag").alias("run")).agg(*aggs)
    return wide.select(
        "run",
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in IMPORTANCE_FEATURES])).alias("_s"),
    ).select("run", "_s.*")


CONTRIBUTION_WEIGHTS = [("l_quantity", 1000.0), ("l_discount", -5000.0), ("l_tax", 2000.0)]


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (l_orderkey, l_linenumber, feature, value) contributions of a
    fixed linear rule: value = w * (x - mean(x))."""
    li = table(spark, sf_dir, "lineitem")
    means = li.agg(*[F.avg(c).alias(f"m_{c}") for c, _ in CONTRIBUTION_WEIGHTS])  # one row
    j = li.crossJoin(F.broadcast(means))
    return j.select(
        "l_orderkey",
        "l_linenumber",
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.col(f"m_{c}"))).alias("value")) for c, w in CONTRIBUTION_WEIGHTS])).alias("_s"),
    ).select("l_orderkey", "l_linenumber", "_s.*")


# ---------------------------------------------------------------- SQL side

LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

SQL = {
    "li_nulls": "SELECT " + ", ".join(
        "CASE WHEN l_discount = 0.0 THEN NULL ELSE {0} END AS {0}".format(c) if c in ("l_discount", "l_returnflag") else c
        for c in LINEITEM_COLS
    ) + " FROM lineitem",
    "doc_labels": "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                  "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "cust_const": "SELECT *, 'X' AS c_const, c_acctbal AS c_acctbal_copy, 0.0::DOUBLE AS c_zero FROM customer",
    "cust_dup": "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey < 100",
    "li_2x2": "SELECT * FROM lineitem WHERE l_returnflag <> 'N'",
    "dates_as_text": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                     "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
    "pred_binary": "SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y_true, "
                   "CAST(o_totalprice / 500000.0 > 0.5 AS INTEGER) AS y_pred, o_totalprice / 500000.0 AS score FROM orders",
    "pred_multi": "SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS y_true, "
                  "CASE WHEN l_quantity <= 17 THEN 'A' WHEN l_quantity <= 34 THEN 'N' ELSE 'R' END AS y_pred, "
                  "CASE WHEN l_quantity <= 17 THEN 0.6 WHEN l_quantity <= 34 THEN 0.2 ELSE 0.2 END::DOUBLE AS p_A, "
                  "CASE WHEN l_quantity <= 17 THEN 0.25 WHEN l_quantity <= 34 THEN 0.5 ELSE 0.25 END::DOUBLE AS p_N, "
                  "1.0::DOUBLE - CASE WHEN l_quantity <= 17 THEN 0.6 WHEN l_quantity <= 34 THEN 0.2 ELSE 0.2 END::DOUBLE "
                  "- CASE WHEN l_quantity <= 17 THEN 0.25 WHEN l_quantity <= 34 THEN 0.5 ELSE 0.25 END::DOUBLE AS p_R "
                  "FROM lineitem",
    "pred_reg": "SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS y_true, l_quantity * 1500.0 AS y_pred, "
                "l_discount AS y_small, l_tax + 0.01 AS y_small_pred FROM lineitem",
    "cv_scores": "SELECT o_orderpriority AS run, o_orderstatus AS model, CAST(o_orderkey % 5 AS INTEGER) AS fold, "
                 "'balanced_accuracy' AS metric, avg(o_totalprice) / 500000.0 AS value FROM orders GROUP BY 1, 2, 3",
    "importances": "SELECT l_returnflag AS run, f.feature, abs(CASE f.feature "
                   + " ".join(f"WHEN '{x}' THEN corr(CAST({x} AS DOUBLE), l_extendedprice)" for x in IMPORTANCE_FEATURES)
                   + " END) AS importance FROM lineitem, (VALUES "
                   + ", ".join(f"('{x}')" for x in IMPORTANCE_FEATURES)
                   + ") f(feature) GROUP BY l_returnflag, f.feature",
}


SQL["contributions"] = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS feature, {w!r} * ({c} - (SELECT avg({c}) FROM lineitem)) AS value FROM lineitem"
    for c, w in CONTRIBUTION_WEIGHTS
)


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture CTEs."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {ctes} {sql}"


SPARK = {
    "li_nulls": li_nulls,
    "doc_labels": doc_labels,
    "cust_const": cust_const,
    "cust_dup": cust_dup,
    "li_2x2": li_2x2,
    "dates_as_text": dates_as_text,
    "pred_binary": pred_binary,
    "pred_multi": pred_multi,
    "pred_reg": pred_reg,
    "cv_scores": cv_scores,
    "importances": importances,
    "contributions": contributions,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a derived fixture by name."""
    if name in SPARK:
        return SPARK[name](spark, sf_dir)
    return table(spark, sf_dir, name)
