"""Column lists (name, Spark type) of the test tables and fixtures.

Used only to write the independent SQL oracles (the Spark side reads the
schema from the data).
"""

from __future__ import annotations

# The schema of the test tables as Spark reads them.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
SCHEMAS["li_nulls"] = SCHEMAS["lineitem"]
SCHEMAS["li_2x2"] = SCHEMAS["lineitem"]
SCHEMAS["doc_labels"] = SCHEMAS["documents"] + [("quality", "int"), ("toxic", "int")]
SCHEMAS["cust_const"] = SCHEMAS["customer"] + [("c_const", "string"), ("c_acctbal_copy", "double"), ("c_zero", "double")]
SCHEMAS["cust_dup"] = SCHEMAS["customer"]
SCHEMAS["dates_as_text"] = [(c, "string" if c == "o_orderdate" else t) for c, t in SCHEMAS["orders"]]

NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}
STRING_TYPES = {"string"}
DATETIME_TYPES = {"timestamp", "timestamp_ntz", "date"}


def family(t: str) -> str:
    if t in NUMERIC_TYPES or t.startswith("decimal"):
        return "numeric"
    if t in STRING_TYPES:
        return "string"
    if t in DATETIME_TYPES:
        return "datetime"
    if t == "boolean":
        return "boolean"
    return "other"


def cols(table: str, fam: str | None = None) -> list[str]:
    return [c for c, t in SCHEMAS[table] if fam is None or family(t) == fam]
