from protloom.llm import _store


def test_tables_are_kept_until_cleared(spark):
    df, path = _store.saved(spark.range(3).toDF("x"), "t")
    assert spark.sparkContext.applicationId in path and df.count() == 3
    _store.forget(spark, path)
    other, _ = _store.saved(spark.range(2).toDF("x"), "t")
    assert other.count() == 2
    _store.clear(spark)
    assert not spark.sparkContext._jvm.java.io.File(_store._own(spark).removeprefix("file:")).exists()
