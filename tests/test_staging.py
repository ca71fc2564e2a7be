from types import SimpleNamespace

import pytest

from pagefacts.plans.staging import ensure_shared_folder, new_folder, scratch, shared_folder, stage


def session(**settings):
    settings = {k.replace("_", "."): v for k, v in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))


def test_folder_is_the_one_the_session_names():
    assert shared_folder(session(spark_checkpoint_dir="hdfs://cluster/shared/")) == "hdfs://cluster/shared"
    cluster = session(spark_master="spark://cluster")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_a_local_session_may_get_a_folder_of_its_own():
    settings = {"spark.master": "local[4]"}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__))
    ensure_shared_folder(spark)
    folder = shared_folder(spark)
    ensure_shared_folder(spark)
    assert shared_folder(spark) == folder
    settings.clear()
    settings["spark.master"] = "local-cluster[2,1,1000]"
    ensure_shared_folder(spark)
    with pytest.raises(RuntimeError):
        shared_folder(spark)


def test_stage(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")
    df = spark.range(5).selectExpr("id", "named_struct('a', id, 'b', array('x')) AS s")
    staged = stage(df, "test")
    assert staged.dtypes == df.dtypes
    assert sorted(map(str, staged.collect())) == sorted(map(str, df.collect()))
    assert stage(df.where("id < 0"), "empty").count() == 0


def test_scratch_is_emptied(spark):
    outside = stage(spark.range(3), "kept")
    with scratch(spark):
        inside = stage(spark.range(3), "scratch")
        assert inside.count() == 3
    assert outside.count() == 3
    (path,) = {f.rsplit("/", 1)[0] for f in inside.inputFiles()}
    assert spark.read.parquet(path).count() == 0
