"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs.

SQL can't express fingerprints and tokens, so there is no ORACLE_SQL; the stages
are tested against brute force instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.llm import decontaminate as dc
from meshwalk.llm import harmonic_packing as hp
from meshwalk.llm import log_templates as lt
from meshwalk.llm import quality_rules as qr
from meshwalk.llm import simhash_tiles as sh
from meshwalk.llm.common import shared_dir, table
from meshwalk.llm.queries import tokenizer_file

#: A document with a larger share of its words in benchmark spans goes as a whole.
MOST_HIT = 0.5


def _like(docs: DataFrame, found: DataFrame, text: Column) -> DataFrame:
    """The struct ``doc`` of ``found`` as the columns of docs, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c.lower(), F.col("doc")[c]).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group go."""
    found = qr.quality_rules(docs).where("kept")
    return found.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines, single or in blocks, go from the texts; no document does."""
    found = lt.drop_templates(docs).drop("lines_info").select(F.struct(*docs.columns).alias("doc"))
    return _like(docs, found, F.col("doc.text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest doc_id."""
    return sh.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans go from the texts; documents that consist mostly of them go."""
    found = dc.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_words=True)
    kept = found.where(F.size(dc.covered(F.col("spans"))) <= MOST_HIT * F.col("n_words"))
    return _like(docs, kept, dc.remove_spans(F.coalesce(F.col("doc.text"), F.lit("")), F.col("spans")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return hp.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs
