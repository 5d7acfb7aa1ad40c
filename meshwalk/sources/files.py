"""Building a catalog from files, and writing one."""

from __future__ import annotations

import json
import posixpath
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.plans.catalog import GraphCatalog
from meshwalk.plans.shipping import ship

ship(__name__)

#: Type names of manifests and what columns become; unsigned types widen.
TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "timestamp_ms": "timestamp", "timestamp_ns": "bigint", "string": "string", "uuid": "string", "bytes": "binary",
}
COMMENTS = ("#", "//", "%")


def read_text_all(spark: SparkSession, path: str) -> str:
    """A small file through Spark's file systems."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = False, columns: list[str] | None = None) -> DataFrame:
    """TSV or CSV, without blank and comment lines; all columns are strings named as given or _c0, _c1 ..."""
    sep = sep or ("," if path.rstrip("/").endswith(".csv") else "\t")
    line = F.trim("value")
    kept = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit(COMMENTS[0])) & ~F.startswith(line, F.lit(COMMENTS[1])) & ~F.startswith(line, F.lit(COMMENTS[2])))
    lines = kept.select(F.col("value"))
    names = columns
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (columns or ["_c0", "_c1"])))
    if header:
        # The header is the first such line of each file; equal lines further down are data.
        at = kept.select("value", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_i"))
        heads = at.groupBy("_f").agg(F.min("_i").alias("_i"))
        first = at.join(heads, ["_f", "_i"]).orderBy("_f").first()
        names = next(iter(__import__("csv").reader([first["value"]], delimiter=sep)))
        first = [first["value"]]
        lines = at.join(F.broadcast(heads), ["_f", "_i"], "left_anti").select("value")
    width = len(next(iter(__import__("csv").reader([first[0]], delimiter=sep))))
    names = names or [f"_c{i}" for i in range(width)]
    schema = ", ".join(f"`{c}` string" for c in names)
    return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None) -> DataFrame:
    fmt = (fmt or posixpath.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet").lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    if fmt in ("csv", "tsv", "txt"):
        return read_delimited(spark, path, "," if fmt == "csv" else "\t", header=columns is not None and fmt == "csv", columns=None)
    raise ValueError(f"unknown format {fmt}")


def _typed(df: DataFrame, attrs: list[dict]) -> list:
    return [F.expr(f"try_cast(`{a.get('column', a['name'])}` AS {TYPES.get(a.get('type', 'string'), a.get('type'))})").alias(a["name"]) for a in attrs]


def from_manifest(spark: SparkSession, path: str) -> GraphCatalog:
    """A catalog as a JSON manifest describes it; file names are relative to the manifest.

    A domain without a file has the keys that its relations mention.
    """
    spec = json.loads(read_text_all(spark, path))
    base, g = posixpath.dirname(path), GraphCatalog(spark)
    at = lambda f: f if "://" in f or f.startswith("/") else f"{base}/{f}"
    names = {d.get("id", i): d["name"] for i, d in enumerate(spec["domains"])} | {d["name"]: d["name"] for d in spec["domains"]}
    key_type = {d["name"]: TYPES.get(d.get("key_type", "string"), "string") for d in spec["domains"]}
    mentioned: dict[str, list[DataFrame]] = {}
    for i, r in enumerate(spec.get("relations", [])):
        df = read_table(spark, at(r["file"]), r.get("format"), [r["src_column"]] if "src_column" in r else None)
        s, t = r.get("src_column", df.columns[0]), r.get("tgt_column", df.columns[1])
        a, b = names[r["src_domain"]], names[r["tgt_domain"]]
        edges = df.select(F.expr(f"try_cast(`{s}` AS {key_type[a]})").alias("src"), F.expr(f"try_cast(`{t}` AS {key_type[b]})").alias("dst"), *_typed(df, r.get("attributes", [])))
        g.add_relation(r.get("name") or f"relation_{i}", edges, "src", "dst", a, b)
        mentioned.setdefault(a, []).append(edges.select(F.col("src").alias("node")))
        mentioned.setdefault(b, []).append(edges.select(F.col("dst").alias("node")))
    for d in spec["domains"]:
        if d.get("file"):
            df = read_table(spark, at(d["file"]), d.get("format"), [d["id_column"]] if "id_column" in d else None)
            key = d.get("id_column", df.columns[0])
            g.add_domain(d["name"], df.select(F.expr(f"try_cast(`{key}` AS {key_type[d['name']]})").alias("node"), *_typed(df, d.get("attributes", []))), "node")
        else:
            keys = mentioned.get(d["name"]) or [spark.createDataFrame([], f"node {key_type[d['name']]}")]
            nodes = keys[0]
            for k in keys[1:]:
                nodes = nodes.unionByName(k)
            g.add_domain(d["name"], nodes.distinct(), "node")
    return g


def save(catalog: GraphCatalog, path: str) -> None:
    """Parquet tables and a description, all through Spark's file systems."""
    spec: dict = {"domains": {}, "relations": {}}
    for n, d in catalog.domains.items():
        d.nodes.write.mode("overwrite").parquet(f"{path}/domains/{n}")
        spec["domains"][n] = {}
    for n, r in catalog.relations.items():
        r.edges.write.mode("overwrite").parquet(f"{path}/relations/{n}")
        spec["relations"][n] = {"src": r.src_domain, "dst": r.dst_domain, "multiplicity": r.multiplicity}
    catalog.spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")


def load(spark: SparkSession, path: str) -> GraphCatalog:
    spec = json.loads(spark.read.text(f"{path}/catalog").first()[0])
    g = GraphCatalog(spark)
    for n in spec["domains"]:
        g.add_domain(n, spark.read.parquet(f"{path}/domains/{n}"), "node")
    for n, r in spec["relations"].items():
        g.add_relation(n, spark.read.parquet(f"{path}/relations/{n}"), "src", "dst", r["src"], r["dst"], None, r["multiplicity"])
    return g


def export(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt in ("jsonl", "json"):
        w.json(path)
    elif fmt in ("csv", "tsv"):
        w.option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


# ------------------------------------------------------------------ embeddings


def _rows(data: bytes, fmt: str) -> np.ndarray:
    if fmt == "npy":
        import io

        return np.atleast_2d(np.load(io.BytesIO(data), allow_pickle=False)).astype(np.float32)
    if fmt in ("fvecs", "ivecs", "bvecs"):
        dim = struct.unpack("<i", data[:4])[0] if data else 0
        size = {"fvecs": 4, "ivecs": 4, "bvecs": 1}[fmt]
        width = 4 + dim * size
        if not data or len(data) % width:
            return np.empty((0, dim), np.float32)
        raw = np.frombuffer(data, np.uint8).reshape(-1, width)[:, 4:].copy()
        return raw.view({"fvecs": "<f4", "ivecs": "<i4", "bvecs": "u1"}[fmt]).astype(np.float32)
    if fmt == "safetensors":
        n = struct.unpack("<Q", data[:8])[0]
        head = json.loads(data[8 : 8 + n])
        for name, t in sorted(head.items()):
            if name != "__metadata__" and len(t["shape"]) == 2:
                a, b = t["data_offsets"]
                kind = {"F32": "<f4", "F64": "<f8", "F16": "<f2", "I32": "<i4", "I64": "<i8", "U8": "u1"}[t["dtype"]]
                return np.frombuffer(data[8 + n + a : 8 + n + b], kind).reshape(t["shape"]).astype(np.float32)
        return np.empty((0, 0), np.float32)
    raise ValueError(f"unknown format {fmt}")


def _emit_rows(fmt: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = _rows(data, fmt)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], names=["file", "row", "embedding"])

    return of


def read_embeddings(spark: SparkSession, path: str, fmt: str | None = None, column: str = "embedding") -> DataFrame:
    """(file, row, embedding) of npy, fvecs, ivecs, bvecs or safetensors files; tables by their vector column."""
    fmt = (fmt or posixpath.splitext(path)[1].lstrip(".")).lower()
    if fmt in ("parquet", "jsonl", "json"):
        df = spark.read.parquet(path) if fmt == "parquet" else spark.read.json(path)
        return df.withColumn("embedding", F.col(column).cast("array<float>"))
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
        key, *rest = df.columns
        return df.select(F.col(key).alias("key"), F.array(*(F.col(c).cast("float") for c in rest)).alias("embedding"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_emit_rows(fmt), "file string, row long, embedding array<float>")


def align(vectors: DataFrame, key: str, catalog: GraphCatalog, domain: str, attr: str = "node", name: str = "embedding") -> GraphCatalog:
    """A catalog whose domain has the vectors as an attribute, missing where there is none."""
    out = GraphCatalog(catalog.spark)
    out.domains, out.relations = dict(catalog.domains), dict(catalog.relations)
    v = vectors.select(F.col(key).alias(attr), F.col("embedding").alias(name)).dropDuplicates([attr])
    nodes = catalog.domain(domain).nodes.join(v, attr, "left")
    return out.add_domain(domain, nodes, "node")


# ----------------------------------------------------------------- interchange


def to_scipy_parts(edges: DataFrame, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the relation as coordinate arrays on the driver."""
    t = edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).toPandas()
    return t["src"].to_numpy(), t["dst"].to_numpy(), t["w"].to_numpy()


def from_coordinates(spark: SparkSession, rows, columns, values=None) -> DataFrame:
    """Edges (src, dst[, weight]) of coordinate arrays, such as a sparse matrix or an edge index."""
    import pandas as pd

    frame = {"src": np.asarray(rows, np.int64), "dst": np.asarray(columns, np.int64)}
    if values is not None:
        frame["weight"] = np.asarray(values, np.float64)
    return spark.createDataFrame(pd.DataFrame(frame))


def from_networkx(spark: SparkSession, graph) -> DataFrame:
    """Edges of anything with ``edges(data=True)``; a missing weight is NULL."""
    return spark.createDataFrame([(int(u), int(v), float(d["weight"]) if "weight" in d else None) for u, v, d in graph.edges(data=True)], "src long, dst long, weight double")


def to_networkx(edges: DataFrame):
    import networkx

    return networkx.from_pandas_edgelist(edges.toPandas(), "src", "dst", create_using=networkx.MultiDiGraph)
