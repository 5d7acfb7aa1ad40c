"""Shared column helpers of the corpus operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.plans.durable import cut, shared_dir

__all__ = ["alnum_words_of", "ascii_lower", "checked", "cut", "let", "running", "shared_dir", "ship", "sized", "small_batches", "table", "text_of", "words_of"]

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything that is not a digit, a lower-case letter or a code point above 127.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column that a lambda refers to is evaluated again for each element, so
    anything costly goes through a lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, chunk: int = 256) -> Column:
    """Sums of an array of longs up to and with each place.

    An array can only grow in an aggregate by being copied, so the sums are taken in
    chunks and the chunks' sums once more.
    """
    none = F.expr("CAST(array() AS array<bigint>)")

    def sums(x: Column, base: Column) -> Column:
        step = lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out"))
        return F.aggregate(x, F.struct(base.alias("at"), none.alias("out")), step, lambda a: a["out"])

    zero = F.lit(0).cast("long")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / chunk).cast("int")), lambda j: F.slice(values, j * chunk + 1, F.lit(chunk)))

    def of(c: Column) -> Column:
        ends = sums(F.transform(c, lambda x: F.aggregate(x, zero, lambda a, v: a + v)), zero)
        return let(ends, lambda e: F.flatten(F.transform(c, lambda x, j: sums(x, F.coalesce(F.get(e, j - 1), zero)))))

    return let(pieces, of)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not white space."""
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Plain ASCII texts take the fast path."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words_of(text: Column) -> Column:
    """Lower-cased words of letters, digits and code points above 127."""
    return F.array_remove(F.split(ascii_lower(text), NOT_ALNUM), "")


#: A table of fewer bytes for each core is dealt anew, as a small file may be one row group, which is one task.
FEW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores = spark.sparkContext.defaultParallelism
    df = spark.read.parquet(path)
    return df.repartition(cores) if size < cores * FEW_BYTES else df


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound an Arrow batch to so many rows; long texts make larger ones costly."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ship(module: str) -> None:
    """Send the functions of a module with each task, as executors may not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: What may be broadcast, counted before it is.
BROADCAST_BYTES = 64 << 20


def checked(df: DataFrame, values: str, bound: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the rows and their lists ``values`` of longs are within the bound."""
    size = df.agg(F.sum(48 + 8 * F.size(values))).first()[0] or 0
    return F.broadcast(df) if size <= bound else df


def sized(df: DataFrame, row_bytes: int = 24, bound: int = BROADCAST_BYTES) -> DataFrame:
    """A cut of a table of keys, with a broadcast hint if its counted rows are within the bound."""
    df = cut(df)
    return F.broadcast(df) if df.count() * row_bytes <= bound else df
