"""Edge programs: expressions evaluated for every edge that leaves a frontier.

A program names values one after the other, each an expression over ``src.attr``,
``edge.attr``, ``tgt.attr`` and earlier names, filters, and reduces into targets or
yields them. It compiles to one join per side that is read and one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions import cel
from meshwalk.plans.catalog import GraphCatalog


@dataclass(frozen=True)
class EdgeProgram:
    catalog: GraphCatalog
    relation: str
    direction: str = "out"
    steps: tuple[tuple[str, str, str], ...] = ()
    params: Mapping[str, Any] | None = None

    def let(self, name: str, expression: str) -> EdgeProgram:
        """A named value. Division by zero and modulo by zero are 0 in edge programs."""
        return EdgeProgram(self.catalog, self.relation, self.direction, (*self.steps, ("let", name, expression)), self.params)

    def where(self, expression: str) -> EdgeProgram:
        """Drop edges where the expression is 0, false or missing."""
        return EdgeProgram(self.catalog, self.relation, self.direction, (*self.steps, ("where", "", expression)), self.params)

    def rows(self, frontier: DataFrame | None = None) -> DataFrame:
        """(src, dst, named values) of the edges that are left."""
        rel = self.catalog.relation(self.relation)
        uses = " ".join(s[2] for s in self.steps)
        df = rel.edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), *(F.col(c).alias(f"_edge_{c}") for c in rel.edges.columns if c not in ("src", "dst")))
        if frontier is not None:
            df = df.join(frontier.select(F.col("node").alias("_src" if self.direction == "out" else "_dst")).distinct(), "_src" if self.direction == "out" else "_dst", "left_semi")
        for side, key, domain in (("src", "_src", rel.src_domain), ("tgt", "_dst", rel.dst_domain)):
            if f"{side}." in uses and domain in self.catalog.domains:
                nodes = self.catalog.domain(domain).nodes.dropDuplicates(["node"])
                df = df.join(nodes.select(F.col("node").alias(key), *(F.col(c).alias(f"_{side}_{c}") for c in nodes.columns if c != "node")), key, "left")
        named: list[str] = []

        def resolve(path: str, df: DataFrame) -> cel.Typed:
            kinds = dict(df.dtypes)
            side, _, attr = path.partition(".")
            ends = {"src": "_src", "tgt": "_dst"} if self.direction == "out" else {"src": "_dst", "tgt": "_src"}
            column = path if path in named else ends[side] if side in ends and attr in ("", "id") else f"_{side}_{attr}" if attr else f"_edge_{path}"
            if side in ("src", "tgt") and attr not in ("", "id") and self.direction == "in":
                column = f"_{'tgt' if side == 'src' else 'src'}_{attr}"
            if column not in kinds:
                raise cel.CelError(f"unknown value {path}")
            found = cel.columns_of([(column, kinds[column])])(column)
            return found

        for kind, name, text in self.steps:
            tree = cel.optimise(cel.parse(text))
            of = _ZeroSafe(lambda p, df=df: resolve(p, df), self.params)
            if kind == "where":
                df = df.where(of.test(tree))
            else:
                t = of.typed(tree)
                df = df.withColumn(name, t.col.cast("double") if t.kind == "bool" else t.col)
                named.append(name)
        a, b = ("_src", "_dst") if self.direction == "out" else ("_dst", "_src")
        return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), *dict.fromkeys(named))

    def reduce(self, name: str, how: str = "SUM", frontier: DataFrame | None = None) -> DataFrame:
        """(node, value[, arg]) per target: SUM, MAX, MIN, COUNT, ARGMIN or ARGMAX (the source, ties by least)."""
        x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        rows = self.rows(frontier).select(F.col("dst").alias("node"), F.col("src"), x.alias("x")).where("x IS NOT NULL")
        g = rows.groupBy("node")
        if how in ("ARGMIN", "ARGMAX"):
            sign = 1 if how == "ARGMIN" else -1
            return g.agg(F.min(F.struct((sign * F.col("x")).alias("v"), "src")).alias("b")).select("node", (sign * F.col("b.v")).alias("value"), F.col("b.src").alias("arg"))
        return g.agg({"SUM": F.sum("x"), "MAX": F.max("x"), "MIN": F.min("x"), "COUNT": F.count("x").cast("double")}[how].alias("value"))

    def targets(self, frontier: DataFrame | None = None) -> DataFrame:
        """The set of targets of the edges that are left."""
        return self.rows(frontier).select(F.col("dst").alias("node")).distinct()


class _ZeroSafe(cel.Compiler):
    """Division and modulo by zero give 0, as edge programs define."""

    def operator(self, n: cel.Op) -> cel.Typed:
        out = super().operator(n)
        if n.name in ("/", "%"):
            by = self.typed(n.args[1]).col.cast("double")
            return cel.Typed(F.when(by == 0, F.lit(0.0)).otherwise(out.col.cast("double")), "double")
        return out
