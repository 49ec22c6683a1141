import time

from pyspark.sql import functions as F
from rollbook.llm import base


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(2000).withColumn("k", F.col("id") % 50)
    totals = rows.groupBy("k").agg(F.sum("id").alias("total"))
    given = rows.join(totals.hint("merge"), "k")
    before, was = shuffle_files(spark), spark.conf.get(base.CLEANUP, None)
    got = base.materialise(given)
    for _ in range(100):  # removal goes on beside the query
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(base.CLEANUP, None) == was
    assert got.columns == given.columns and got.count() == 2000
    assert got.exceptAll(given).isEmpty()  # the table given can be run again
