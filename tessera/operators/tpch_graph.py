"""A property graph laid over the star-schema tables, without copying them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .graph import Rel, TypedGraph

#: First id of each label; keys are added to it.
FIRST = {"Region": 1_000, "Nation": 2_000, "Customer": 10_000_000_000, "Supplier": 20_000_000_000, "Part": 30_000_000_000, "Order": 40_000_000_000}
TYPES = {"name": "string", "acctbal": "real", "segment": "string", "active": "boolean", "brand": "string", "size": "integer", "price": "real", "status": "string", "total": "real", "priority": "string", "quantity": "real", "discount": "real", "line": "integer"}


def _id(label: str, key: str):
    return (F.lit(FIRST[label]) + F.col(key)).cast("bigint")


def tpch_graph(spark: SparkSession, sf_dir: str) -> TypedGraph:
    """Frames are made when a pattern asks for them, so that a query opens only the tables that it reads."""
    t = lambda name: table(spark, sf_dir, name)
    c = lambda name, alias: F.col(name).alias(alias)
    labels = {
        "Region": lambda: t("region").select(_id("Region", "r_regionkey").alias("id"), c("r_name", "name")),
        "Nation": lambda: t("nation").select(_id("Nation", "n_nationkey").alias("id"), c("n_name", "name")),
        "Customer": lambda: t("customer").select(_id("Customer", "c_custkey").alias("id"), c("c_name", "name"), c("c_acctbal", "acctbal"), c("c_mktsegment", "segment"), (F.col("c_acctbal") >= 0).alias("active")),
        "Supplier": lambda: t("supplier").select(_id("Supplier", "s_suppkey").alias("id"), c("s_name", "name"), c("s_acctbal", "acctbal"), (F.col("s_acctbal") >= 0).alias("active")),
        "Part": lambda: t("part").select(_id("Part", "p_partkey").alias("id"), c("p_name", "name"), c("p_brand", "brand"), c("p_size", "size"), c("p_retailprice", "price")),
        "Order": lambda: t("orders").select(_id("Order", "o_orderkey").alias("id"), c("o_orderstatus", "status"), c("o_totalprice", "total"), c("o_orderpriority", "priority")),
    }

    def edges(table: str, first, src: tuple[str, str], dst: tuple[str, str], *props) -> DataFrame:
        return t(table).select(first.cast("bigint").alias("id"), _id(*src).alias("src"), _id(*dst).alias("dst"), *props)

    customer, supplier, nation, order = ("Customer", "c_custkey"), ("Supplier", "s_suppkey"), ("Nation", "n_nationkey"), ("Order", "o_orderkey")
    rels = (
        Rel("IN_REGION", "Nation", "Region", lambda: edges("nation", _id(*nation), nation, ("Region", "n_regionkey"))),
        Rel("IN_NATION", "Customer", "Nation", lambda: edges("customer", _id(*customer), customer, ("Nation", "c_nationkey"))),
        Rel("IN_NATION", "Supplier", "Nation", lambda: edges("supplier", _id(*supplier), supplier, ("Nation", "s_nationkey"))),
        Rel("PLACED", "Customer", "Order", lambda: edges("orders", _id(*order), ("Customer", "o_custkey"), order, c("o_totalprice", "total"))),
        Rel("CONTAINS", "Order", "Part", lambda: edges("lineitem", F.lit(1 << 40) + F.col("l_orderkey") * 16 + F.col("l_linenumber"), ("Order", "l_orderkey"), ("Part", "l_partkey"), c("l_quantity", "quantity"), c("l_discount", "discount"), c("l_linenumber", "line"))),
    )
    return TypedGraph(labels, rels, TYPES)
