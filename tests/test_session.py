import pytest

from tidemark import session


def test_width_grows_with_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).write.parquet(path)
    df = spark.read.parquet(path)
    assert session.shuffle_width(df) == 4
    assert session.shuffle_width(df.join(df.withColumnRenamed("id", "x")), part=10_000) > 100
    assert session.shuffle_width(df, part=1, most=50) == 50
    assert session.shuffle_width(spark.createDataFrame([], "a int")) == 4
    assert session.shuffle_width(session.cut(df.limit(9)), part=1) == 4


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.cut(Frame())
