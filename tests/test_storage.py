import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from latticework import storage
from latticework.operators.algorithms import components


def test_cluster_without_a_shared_folder_is_an_error(spark):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master, ok in (("local[4]", True), ("local", True), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: None))
        if ok:
            assert storage.shared_dir(fake).startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                storage.shared_dir(fake)
    named = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="a", getCheckpointDir=lambda: "hdfs:///c/"))
    assert storage.shared_dir(named) == "hdfs:///c"


def test_tables_go_at_the_end_of_a_block(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
    nodes = spark.range(1, 8)
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    with storage.temporary(spark):
        assert components(nodes, edges).where("component = 1").count() == 3
        assert os.listdir(tmp_path)
    assert not os.listdir(tmp_path)
    scratch = storage.Scratch(spark)
    a, b = scratch.put(nodes), scratch.put(edges)
    scratch.drop(a)
    assert [x for x in os.listdir(f"{tmp_path}/{os.path.basename(scratch.root)}") if x[0] == "t"] == ["t2"] and b.count() == 3
    scratch.clear()
    assert not os.listdir(tmp_path)


def test_shuffle_files_go_with_the_query(spark):
    """What a written table shuffled is deleted at once: the block managers know no more shuffle blocks than before."""

    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        return manager.shuffleStatuses().size()

    before = files()
    back = storage.Scratch(spark).put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and back.count() == 7
