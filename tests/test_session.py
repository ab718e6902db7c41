from pyspark.sql import functions as F

from dqspark.session import CLEANUP, materialize


def test_a_written_table_leaves_no_shuffle_files(spark):
    spark.conf.unset(CLEANUP)
    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = held()
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    stored = materialize(df)
    assert held() == before
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, stored.collect()))
