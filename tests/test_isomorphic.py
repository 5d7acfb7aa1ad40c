from pyspark.sql import functions as F

from meshwalk.operators import algorithms as G


def test_all_colours_are_compared(spark):
    """Paths to the one of edges out of a hub whose lengths differ: more colours than 100,001 on each side."""
    a = spark.range(150_000).select("id", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("bit")).where("shiftright(id, CAST(bit AS INT)) & 1 = 1").select(F.col("id").alias("src"), (-1 - F.col("bit")).alias("dst"))
    marks = spark.range(17).select(F.explode(F.sequence(F.lit(0), "id")).alias("k"), "id").select((-1 - F.col("id")).alias("src"), (-1000 - 100 * F.col("id") - F.col("k")).alias("dst"))
    a = a.unionByName(marks)
    b = a.select((F.col("src") * 7 + 3).alias("src"), (F.col("dst") * 7 + 3).alias("dst")).repartition(5, "dst")
    assert G.isomorphic(a, b, rounds=2)
    assert not G.isomorphic(a, b.where("NOT (src = 70003 AND dst = -4)").unionByName(spark.createDataFrame([(70003, -11)], "src long, dst long")), rounds=2)
