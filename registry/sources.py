"""Loading, first rows, samples and document checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query, read
from seriesmill.sources import tables as S


@query(
    "a1_load_table",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1",
)
def a1(spark, d):
    df = S.require_shape(S.load_table(spark, f"{d}/lineitem.parquet"))
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


_CUSTOMER = {
    "c_custkey": "CAST(c_custkey AS VARCHAR)",
    "c_name": "c_name",
    "c_nationkey": "CAST(c_nationkey AS VARCHAR)",
    "c_acctbal": "CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS VARCHAR)",
    "c_mktsegment": "CASE WHEN c_custkey < 1000 THEN NULL ELSE c_mktsegment END",
}
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", c_custkey AS k, {e} AS value FROM customer" for c, e in _CUSTOMER.items()
)


@query(
    "a4_sample_values",
    f"WITH l AS ({_LONG}), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY k) AS rank FROM l WHERE value IS NOT NULL) "
    'SELECT "column", CAST(rank AS INTEGER) AS rank, value FROM r WHERE rank <= 5',
)
def a4(spark, d):
    df = read(spark, d, "customer").selectExpr(
        "c_custkey", "c_name", "c_nationkey", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal",
        "CASE WHEN c_custkey < 1000 THEN NULL ELSE c_mktsegment END AS c_mktsegment",
    )
    return S.sample_values(df, "c_custkey", 5)


@query("a5_head_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def a5(spark, d):
    return S.head_rows(read(spark, d, "orders"), "o_orderkey", 50)


_STATUS = {"F": "task_spec", "O": "comparison_table", "P": "run_summary"}
_NEEDS = {
    "task_spec": ["run_id", "target_col", "task_type"],
    "comparison_table": ["ranked_by", "ranking", "run_id"],
    "run_summary": ["assembled_at", "run_id", "stages"],
}
_SCHEMA = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"
# which order supplies which field; a field without a value is left out of the document
_HAS = {
    "run_id": "true",
    "target_col": "o_orderpriority <> '1-URGENT'",
    "task_type": "o_custkey % 10 > 0",
    "ranked_by": "o_orderpriority <> '5-LOW'",
    "ranking": "o_totalprice > 100000",
    "assembled_at": "o_custkey % 3 > 0",
    "stages": "o_totalprice < 400000",
}
_GONE = " || ".join(
    f"CASE WHEN {_SCHEMA} = '{s}' AND NOT ({_HAS[f]}) THEN '{f};' ELSE '' END"
    for s, fields in _NEEDS.items()
    for f in fields
)


@query(
    "a8_artifact_contract_check",
    f"SELECT o_orderkey, {_SCHEMA} AS schema_name, {_GONE} AS missing_fields, {_GONE} = '' AS valid FROM orders",
)
def a8(spark, d):
    orders = read(spark, d, "orders").withColumn("schema_name", F.expr(_SCHEMA.replace("VARCHAR", "STRING")))
    fields = [F.when(F.expr(test), F.col("o_orderkey").cast("string")).alias(f) for f, test in _HAS.items()]
    docs = orders.select("o_orderkey", "schema_name", F.to_json(F.struct(*fields)).alias("doc"))
    out = S.contract_check(docs)
    text = F.array_join(F.transform("missing_fields", lambda f: F.concat(f, F.lit(";"))), "")
    return out.select("o_orderkey", "schema_name", text.alias("missing_fields"), "valid")
