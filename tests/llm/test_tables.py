from pyspark.sql import functions as F

from quire.llm.tables import bounded_sample


def test_copies_do_not_shrink_the_sample(spark):
    few = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("body"))
    hot = spark.range(400000).select(F.lit("hot").alias("body"))
    got = bounded_sample(few.unionByName(hot), 300)
    assert len(got) == 300
    assert got == bounded_sample(few.unionByName(hot.limit(1)), 300)
