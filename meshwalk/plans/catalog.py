"""The property graph as a catalog of node and edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """A typed node set: ``nodes`` has the key as ``node`` and the attributes."""

    name: str
    nodes: DataFrame


@dataclass(frozen=True)
class Relation:
    """A directed relation: ``edges`` has ``src``, ``dst`` and the attributes.

    ``multiplicity`` is the average number of targets of a source where known; two
    forward hops over relations of at most 2 are planned without the distinct
    between them.
    """

    name: str
    edges: DataFrame
    src_domain: str
    dst_domain: str
    multiplicity: float | None = None
    parts: tuple[str, ...] = field(default=())


class GraphCatalog:
    """Domains and relations by name. Rows are read lazily; nothing is copied."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.domains: dict[str, Domain] = {}
        self.relations: dict[str, Relation] = {}

    def add_domain(self, name: str, df: DataFrame, key: str) -> GraphCatalog:
        """Rows without a key aren't nodes; a key that repeats is one node with the attributes of any of its rows."""
        nodes = df.withColumnRenamed(key, "node") if key != "node" else df
        self.domains[name] = Domain(name, nodes.where(F.col("node").isNotNull()))
        return self

    def add_relation(self, name: str, df: DataFrame, src: str, dst: str, src_domain: str, dst_domain: str, attrs: Iterable[str] | None = None, multiplicity: float | None = None) -> GraphCatalog:
        """Edges with a missing end aren't edges; parallel edges stay."""
        attrs = [c for c in df.columns if c not in (src, dst)] if attrs is None else list(attrs)
        edges = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *attrs).where("src IS NOT NULL AND dst IS NOT NULL")
        self.relations[name] = Relation(name, edges, src_domain, dst_domain, multiplicity)
        return self

    def add_virtual(self, name: str, parts: Iterable[str]) -> GraphCatalog:
        """The union of relations between the same domains."""
        found = [self.relation(p) for p in parts]
        if len({(r.src_domain, r.dst_domain) for r in found}) != 1:
            raise ValueError(f"the parts of {name} join different domains")
        edges = found[0].edges.select("src", "dst")
        for r in found[1:]:
            edges = edges.unionByName(r.edges.select("src", "dst"))
        self.relations[name] = Relation(name, edges, found[0].src_domain, found[0].dst_domain, None, tuple(r.name for r in found))
        return self

    def domain(self, name: str) -> Domain:
        if name not in self.domains:
            raise ValueError(f"unknown domain {name}")
        return self.domains[name]

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise ValueError(f"unknown relation {name}")
        return self.relations[name]

    def has_relation(self, name: str) -> bool:
        return name in self.relations

    def has_key_catalog(self, domain: str) -> bool:
        return domain in self.domains

    def edge_ids(self, name: str) -> DataFrame:
        """The edges with ``edge_id`` from 0 in the order of (src, dst, attributes).

        Range-partitioned, sorted in partitions and numbered by partition offsets, so
        no single task sees all edges.
        """
        return number_rows(self.relation(name).edges, ["src", "dst"], "edge_id")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of the columns, then of all others."""
    from .durable import cut

    rest = [c for c in df.columns if c not in order]
    sortable = [*order, *(F.to_json(c) if t.startswith(("map", "variant")) else F.col(c) for c, t in df.select(*rest).dtypes)]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*sortable)
    placed = cut(placed.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")).orderBy("_p").collect()
    shifts, at = [], 0
    for r in sizes:  # one row for each partition
        shifts.append((r["_p"], at - r["_first"]))
        at += r["_n"]
    offset = df.sparkSession.createDataFrame(shifts or [(0, 0)], "_p int, _shift long")
    return placed.join(F.broadcast(offset), "_p").withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")
