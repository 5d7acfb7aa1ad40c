import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from meshwalk.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    base = tmp_path_factory.mktemp("stages")
    out.append(docs)
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, SF).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs)
    return out


def test_columns_and_rows(stages):
    first = stages[0]
    for a, b in zip(stages[:4], stages[1:5], strict=True):
        assert b.columns == first.columns and b.dtypes == first.dtypes
        assert b.join(a, "doc_id", "left_anti").isEmpty() and b.count() == b.select("doc_id").distinct().count()
    assert all(d.where(F.col("n_chars") != F.length("text")).isEmpty() for d in stages[1:5])


def test_stages_take_effect(spark, stages):
    assert stages[1].count() < stages[0].count() and stages[3].count() < stages[2].count() == stages[1].count()
    assert stages[2].agg(F.sum("n_chars")).first()[0] <= stages[1].agg(F.sum("n_chars")).first()[0]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not dc.decontaminate(stages[3], bench).where(F.size("spans") > 0).isEmpty()
    assert dc.decontaminate(stages[4], bench).where(F.size("spans") > 0).isEmpty()


def test_all_that_is_left_is_packed(stages):
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert packed.where("n <> t").isEmpty() and packed.count() == stages[4].count()


def test_run_is_the_stages(spark, stages):
    assert cp.run(spark, SF).groupBy("doc_id").agg(F.sum("length")).count() == stages[4].count()
