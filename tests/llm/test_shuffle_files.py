import time

from assurelake.llm.common import cut


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    """The shuffle files of a table that was written go with it, without waiting for the driver's garbage collection."""
    before = shuffle_files(spark)
    rows = cut(spark.range(1000).repartition(4, "id").groupBy("id").count(), "test-cut")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and rows.count() == 1000
