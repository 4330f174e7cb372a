from types import SimpleNamespace

import pytest

from protloom import scratch as sc


def test_saved_tables(spark):
    df, path = sc.saved(spark.range(100, numPartitions=4).toDF("x"), "t", rows=100)
    assert df.count() == 100 and df.rdd.getNumPartitions() == 1 and spark.sparkContext.applicationId in path
    sc.forget(spark, path)
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).exists()


def fake(master, **conf):
    own = SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
    return SimpleNamespace(conf=own, sparkContext=SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: own))


def test_the_shared_folder():
    told = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert sc.shared_root(fake("spark://host:7077", **told)) == sc.shared_root(fake("local[2]", **told)) == "hdfs://x/y"
    assert sc.shared_root(fake("local[2]")) == sc.shared_root(fake("local[2]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir is not set"):
            sc.shared_root(fake(master))


def test_sizes_of_the_application_stay(spark):
    set_ = {}
    session = SimpleNamespace(conf=SimpleNamespace(set=set_.__setitem__), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key, default=None: {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.hadoop.parquet.page.size": "9"}.get(key, default))))
    sc.bounded_batches(session)
    assert set(set_) == set(sc.BATCH_SIZES) - {"spark.sql.execution.arrow.maxRecordsPerBatch", "parquet.page.size"}
