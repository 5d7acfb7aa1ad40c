"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshwalk.plans.catalog import GraphCatalog


#: Schemas by application and path: the tables are immutable, so their footers are read once.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def co_bought(lineitem: DataFrame) -> DataFrame:
    """(src, dst, orders): parts in one order, both ways, with the number of orders that hold both."""
    items = lineitem.select("l_orderkey", "l_partkey").distinct()
    met = items.alias("a").join(items.alias("b"), F.col("a.l_orderkey") == F.col("b.l_orderkey")).where("a.l_partkey <> b.l_partkey")
    return met.groupBy(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).agg(F.count("*").alias("orders"))


def next_event(events: DataFrame) -> DataFrame:
    """(src, dst, gap): each user's events in order of time."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    led = events.withColumn("dst", F.lead("event_id").over(by)).withColumn("gap", F.unix_micros(F.lead("ts").over(by).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    return led.where("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", (F.col("gap") / 1e6).alias("gap"))


def graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    t = lambda n: read(spark, sf_dir, n)
    g = GraphCatalog(spark)
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("events", "event_id"), ("embeddings", "vec_id")):
        g.add_domain(name, t(name), key)
    g.add_relation("PLACED", t("orders"), "o_custkey", "o_orderkey", "customer", "orders", ["o_orderdate", "o_totalprice"])
    g.add_relation("CONTAINS", t("lineitem"), "l_orderkey", "l_partkey", "orders", "part", ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    g.add_relation("SUPPLIED_BY", t("lineitem"), "l_partkey", "l_suppkey", "part", "supplier", ["l_quantity"])
    g.add_relation("CUST_IN", t("customer"), "c_custkey", "c_nationkey", "customer", "nation", [], 1.0)
    g.add_relation("SUPP_IN", t("supplier"), "s_suppkey", "s_nationkey", "supplier", "nation", [], 1.0)
    g.add_relation("NATION_IN", t("nation"), "n_nationkey", "n_regionkey", "nation", "region", [], 1.0)
    g.add_relation("CO_BOUGHT", co_bought(t("lineitem")), "src", "dst", "part", "part", ["orders"])
    g.add_relation("NEXT_EVENT", next_event(t("events")), "src", "dst", "events", "events", ["gap"], 1.0)
    turns = t("conversations").select("conv_id", "turn").distinct()
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = turns.join(following, ["conv_id", "turn"], "left_semi").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"))
    g.add_domain("turn", turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn"), "node")
    g.add_relation("NEXT_TURN", pairs.withColumn("dst", F.col("src") + 1), "src", "dst", "turn", "turn", [], 1.0)
    return g
