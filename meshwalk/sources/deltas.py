"""Changes of an immutable graph: deltas, merges, comparison and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.plans.catalog import Domain, GraphCatalog, Relation


def apply(base: DataFrame, adds: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """Edges after removing (src, dst) tombstones from the base and adding edges; a set of (src, dst, attributes)."""
    out = base if tombstones is None else base.join(tombstones.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    if adds is not None:
        out = out.unionByName(adds, allowMissingColumns=True)
    return out.distinct()


def compact(catalog: GraphCatalog, name: str, adds: DataFrame | None = None, tombstones: DataFrame | None = None) -> GraphCatalog:
    """A catalog in which the relation has its delta applied; the old one is untouched."""
    out = GraphCatalog(catalog.spark)
    out.domains, out.relations = dict(catalog.domains), dict(catalog.relations)
    r = catalog.relation(name)
    out.relations[name] = Relation(name, apply(r.edges, adds, tombstones), r.src_domain, r.dst_domain)
    return out


def merge(a: GraphCatalog, b: GraphCatalog) -> GraphCatalog:
    """Domains and relations of both; what both have is the union of their rows, b's row standing for a key of both."""
    out = GraphCatalog(a.spark)
    out.domains, out.relations = {**a.domains, **b.domains}, {**a.relations, **b.relations}
    for n in a.domains.keys() & b.domains.keys():
        x, y = a.domains[n].nodes, b.domains[n].nodes
        out.domains[n] = Domain(n, y.unionByName(x.join(y.select("node"), "node", "left_anti"), allowMissingColumns=True))
    for n in a.relations.keys() & b.relations.keys():
        x, y = a.relations[n], b.relations[n]
        if (x.src_domain, x.dst_domain) != (y.src_domain, y.dst_domain):
            raise ValueError(f"{n} joins different domains")
        out.relations[n] = Relation(n, x.edges.unionByName(y.edges, allowMissingColumns=True).distinct(), x.src_domain, x.dst_domain)
    return out


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, columns): rows that only one side has, repeats counted."""
    cols = a.columns
    gone = a.exceptAll(b.select(cols)).select(F.lit("removed").alias("change"), *cols)
    return gone.unionByName(b.select(cols).exceptAll(a).select(F.lit("added").alias("change"), *cols))


def catalog_diff(a: GraphCatalog, b: GraphCatalog) -> DataFrame:
    """(kind, name, what, before, after) of differences of names, columns and row counts."""
    rows = []
    for kind, x, y, df in (("domain", a.domains, b.domains, lambda d: d.nodes), ("relation", a.relations, b.relations, lambda r: r.edges)):
        for n in sorted(x.keys() | y.keys()):
            if (n in x) != (n in y):
                rows.append((kind, n, "exists", str(n in x), str(n in y)))
                continue
            p, q = df(x[n]), df(y[n])
            if p.dtypes != q.dtypes:
                rows.append((kind, n, "columns", str(p.dtypes), str(q.dtypes)))
            if (i := p.count()) != (j := q.count()):
                rows.append((kind, n, "rows", str(i), str(j)))
    return a.spark.createDataFrame(rows, "kind string, name string, what string, before string, after string")


def dangling(catalog: GraphCatalog, relations: list[str] | None = None) -> DataFrame:
    """(relation, side, missing): edges whose end isn't a node of the domain."""
    parts = []
    for name in relations or sorted(catalog.relations):
        r = catalog.relation(name)
        for side, domain in (("src", r.src_domain), ("dst", r.dst_domain)):
            nodes = catalog.domain(domain).nodes.select(F.col("node").alias(side))
            parts.append(r.edges.join(nodes, side, "left_anti").agg(F.lit(name).alias("relation"), F.lit(side).alias("side"), F.count("*").alias("missing")))
    return reduce(DataFrame.unionByName, parts)


def inspect(catalog: GraphCatalog) -> DataFrame:
    """(kind, name, ends, columns) without reading any rows."""
    rows = [("domain", n, "", ", ".join(f"{c} {t}" for c, t in d.nodes.dtypes)) for n, d in catalog.domains.items()]
    rows += [("relation", n, f"{r.src_domain} -> {r.dst_domain}", ", ".join(f"{c} {t}" for c, t in r.edges.dtypes)) for n, r in catalog.relations.items()]
    return catalog.spark.createDataFrame(rows, "kind string, name string, ends string, columns string")


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """n rows for looking at."""
    return df.limit(n)


def transmute(df: DataFrame, casts: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """Columns with other types, without some, under other names; values that don't fit are NULL."""
    out = df.select(*(F.expr(f"try_cast(`{c}` AS {casts[c]})").alias(c) if casts and c in casts else F.col(c) for c in df.columns))
    return out.drop(*(drop or [])).withColumnsRenamed(rename or {})


def clustered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows laid out by ranges of the keys, for scans that skip."""
    placed = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return placed.sortWithinPartitions(*keys)
