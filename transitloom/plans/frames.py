"""Tables of the driver read as the engine's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A full order of the events of a journey: equal rows are interchangeable.
ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def journeys(t) -> DataFrame:
    """Stop events: trip, stn (nation of the supplier), region, t (day), wait, and the columns of ORDER."""
    events = t("lineitem").select("l_orderkey", *ORDER)
    joined = events.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("l_orderkey").alias("trip"), F.col("s_nationkey").alias("stn"), F.col("n_regionkey").alias("region"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("t"), F.col("l_quantity").cast("int").alias("wait"), *ORDER)


def service_days(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("service"), F.to_date("ts").alias("day")).distinct()


def order_nations(t) -> DataFrame:
    """Line items with src (nation of the customer) and trg (nation of the supplier)."""
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.withColumn("src", F.col("c_nationkey")).withColumn("trg", F.col("s_nationkey"))


def points(t) -> DataFrame:
    """id, x and y in metres from the first two dimensions of `embeddings`, and label."""
    e = t("embeddings").where("vec_id is not null and size(embedding) >= 2")
    return e.select(F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 10000).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 10000).alias("y"), "label")
