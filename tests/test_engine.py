import pytest

from paperloom import engine


def test_bounded_sample(spark):
    df = spark.range(50_000)
    a = [r.id for r in engine.bounded_sample(df, "id", 100).collect()]
    assert len(a) == 100 and a == [r.id for r in engine.bounded_sample(df.repartition(7), "id", 100).collect()]
    assert engine.bounded_sample(df.limit(30), "id", 100).count() == 30 and engine.bounded_sample(df.limit(0), "id", 5).count() == 0
    assert max(a) > 25_000


def test_kept_tables(spark):
    df = spark.createDataFrame([(1, "x", [1.5]), (None, None, None)], "a int, b string, c array<double>")
    for f in (engine.cut, engine.keep):
        got = f(df)
        assert got.schema.simpleString() == df.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_a_cluster_needs_a_shared_folder():
    """Without a shared folder intermediate tables have a place on a local master only."""

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        engine.checkpoint_dir(Session())
