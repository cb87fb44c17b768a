import zlib

from pyspark.sql import functions as F

from credsift.llm import common


def test_folds(spark):
    ids = [0, 1, 2, 17, 123456789, -5, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.held_out("doc_id").alias("h"), common.learn_from("doc_id").alias("l")).collect()
    for r in rows:
        out = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert (r.h, r.l) == (out, not out and r.doc_id is not None)


def test_bounded_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(5000)
    take = lambda d, total=None: [r.id for r in common.bounded_sample(d, 50, "id", total).collect()]
    assert take(df) == take(df.repartition(7)) == take(df, 5000)
    assert len(take(df)) == 50 and len(take(df.limit(9), 9)) == 9


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Row int, _row int")
    assert common.free_name(df, "row") == "__row"


def test_written_and_discarded(spark):
    common.discard(spark)
    df = common.written(spark.range(10).withColumn("x", F.lit("a")), "test")
    assert df.count() == 10
    assert common.discard(spark) == 1 and common.discard(spark) == 0
