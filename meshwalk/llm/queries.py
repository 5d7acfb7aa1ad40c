"""Registered queries opN_<name> of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining as ct
from . import debruijn_dedup as db
from . import decontaminate as dc
from . import harmonic_packing as hp
from . import license_scan as ls
from . import log_templates as lt
from . import quality_rules as qr
from . import secret_scan as ss
from . import simhash_tiles as sh
from . import toxic_fm as tf
from .common import table
from .oracles import all_sql


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qr.quality_rules(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc.doc_id", *qr.COUNTS, "base_failed", "kept")


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ct.features(table(spark, sf_dir, "documents"), ["doc_id"])
    model = ct.train(rows, table(spark, sf_dir, "labels"), held_out=tf.held_out)
    return ct.digest(ct.score(rows, model), tf.held_out)


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.digest(ss.secret_scan(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.digest(db.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"]))


def op5_toxic_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tf.digest(tf.score(docs, tf.train(docs, table(spark, sf_dir, "labels")), ["doc_id"]))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.digest(dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]))


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.digest(sh.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"]))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hp.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lt.digest(lt.drop_templates(table(spark, sf_dir, "documents")))


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.digest(ls.license_scan(table(spark, sf_dir, "documents"), carry=["doc_id"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_mcd, op2_cotraining, op3_secret_links, op4_debruijn_dedup, op5_toxic_fm,
        op6_decontaminate, op7_simhash_tiles, op8_harmonic_packing, op9_log_templates, op10_license_join,
    )
}
ORACLES: dict[str, str] = all_sql()
