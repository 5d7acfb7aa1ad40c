"""What secondary indexes answer, as predicates that Parquet and Catalyst can use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_range(nodes: DataFrame, attr: str, low: float, high: float) -> DataFrame:
    """(node, value) with low <= value <= high, in the order of values; NaN or turned bounds find nothing."""
    if low != low or high != high or low > high:
        return nodes.select("node", F.col(attr).alias("value")).where(F.lit(False))
    x = F.col(attr)
    found = nodes.where(x.between(low, high))
    return found.select("node", x.alias("value")).orderBy("value", "node")


def equals(nodes: DataFrame, attr: str, key) -> DataFrame:
    return nodes.where(F.col(attr) == key).select("node")


def keys_to_nodes(keys: DataFrame, nodes: DataFrame, attr: str) -> DataFrame:
    """(key, node); unknown keys drop out."""
    return keys.select("key").distinct().join(nodes.select(F.col(attr).alias("key"), "node"), "key")


def nodes_to_keys(frontier: DataFrame, nodes: DataFrame, attr: str) -> DataFrame:
    return frontier.select("node").join(nodes.select("node", F.col(attr).alias("key")), "node")


def value_map(frontier: DataFrame, nodes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for each node of the set, as a two-column frame."""
    return frontier.select("node").join(nodes.select("node", F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")), "node").select("key", "value")


def trigram_candidates(nodes: DataFrame, attr: str, query: str) -> DataFrame:
    """Rows that hold every trigram of the query, which may be more than hold the query."""
    if len(query) < 3:
        raise ValueError("a query has three characters at least")
    test = F.lit(True)
    for tri in sorted({query[i : i + 3] for i in range(len(query) - 2)}):
        test = test & F.contains(F.col(attr), F.lit(tri))
    return nodes.where(test).select("node")


def substring(nodes: DataFrame, attr: str, query: str) -> DataFrame:
    return nodes.where(F.contains(F.col(attr), F.lit(query))).select("node")


def domain_part(nodes: DataFrame, attr: str, part: str) -> DataFrame:
    """Rows whose text after the first @ (the whole text without one) is the given one."""
    x = F.col(attr)
    after = F.when(F.instr(x, "@") > 0, F.expr(f"substring(`{attr}`, instr(`{attr}`, '@') + 1)")).otherwise(x)
    return nodes.where(after == part).select("node")


def stabbing(nodes: DataFrame, start: str, duration: str, at: float) -> DataFrame:
    """Rows with start <= at <= start + duration, both ends counting."""
    return nodes.where((F.col(start) <= at) & (F.col(start) + F.col(duration) >= at)).select("node")


def zone_map(nodes: DataFrame, attr: str, low: float, high: float) -> DataFrame:
    """(file, low, high, rows) of the files whose values may meet the range; the scan skips row groups the same way."""
    zones = nodes.groupBy(F.input_file_name().alias("file")).agg(F.min(attr).alias("low"), F.max(attr).alias("high"), F.count("*").alias("rows"))
    return zones.where((F.col("high") >= low) & (F.col("low") <= high))
