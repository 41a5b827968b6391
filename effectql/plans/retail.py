"""The retail model: customers with orders, their lines and the parts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Model, Spec

_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FLAT_SQL = """
SELECT o.o_custkey AS c_custkey, o.o_orderkey, o.o_orderpriority, o.o_orderstatus, l.l_linenumber, l.l_returnflag, l.l_linestatus,
 l.l_quantity, p.p_partkey, p.p_name, p.p_brand, NULLIF(p.p_type, 'LARGE') AS p_type, p.p_size,
 CASE l.l_returnflag WHEN 'A' THEN '<=' WHEN 'N' THEN '>=' WHEN 'R' THEN '==' END AS bound_op, CAST(l.l_quantity AS INT) AS bound_value
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
"""
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULLIF(c_mktsegment, 'FURNITURE') AS c_mktsegment FROM customer"
REGION_SQL = "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer, nation, region = read("customer"), read("nation"), read("region")
    flat = (
        read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_orderstatus", "l_linenumber", "l_returnflag",
            "l_linestatus", "l_quantity", "p_partkey", "p_name", "p_brand", F.nullif("p_type", F.lit("LARGE")).alias("p_type"), "p_size",
            F.when(F.col("l_returnflag") == "A", "<=").when(F.col("l_returnflag") == "N", ">=").when(F.col("l_returnflag") == "R", "==").alias("bound_op"),
            F.col("l_quantity").cast("int").alias("bound_value"),
        )
    )
    places = (
        customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select("c_custkey", "n_name", "r_name")
    )
    parent = customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    return {"customer": parent, "places": places, "flat": flat}


MODEL = Model(
    name="retail", parent="customer", key="c_custkey", order="c_name", unit="o_orderkey",
    projection=("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    fields={
        s.name: s
        for s in (
            Spec("card.key", "parent", "c_custkey", "int"),
            Spec("card.name", "parent", "c_name"),
            Spec("card.segment", "parent", "c_mktsegment", "enum", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
            Spec("card.balance", "parent", "c_acctbal", "number"),
            Spec("card.nation_key", "parent", "c_nationkey", "int"),
            Spec("card.region", "side", "r_name", side="places"),
            Spec("card.nation", "side", "n_name", side="places", like=True),
            Spec("clause.priority", "clause", "o_orderpriority"),
            Spec("clause.status", "clause", "o_orderstatus"),
            Spec("clause.returnflag", "clause", "l_returnflag", "enum", ("A", "N", "R")),
            Spec("clause.quantity", "clause", "l_quantity", "number"),
            Spec("effect.part_name", "predicate", "p_name"),
            Spec("effect.brand", "predicate", "p_brand"),
            Spec("effect.part_type", "predicate", "p_type", "enum", _TYPES, expand={"SMALL": ("SMALL", "MEDIUM"), "LARGE": ("LARGE", "MEDIUM")}),
            Spec("effect.size", "predicate", "p_size", "int"),
            Spec("effect.bound", "predicate", kind="int", pair=("bound_op", "bound_value")),
        )
    },
    sql={"flat": FLAT_SQL, "customer": CUSTOMER_SQL, "places": REGION_SQL}, load=load,
)
