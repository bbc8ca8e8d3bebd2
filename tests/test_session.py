import pytest

from peerlens import session


class Conf(dict):
    pass


class Context:
    def __init__(self, master="local[2]"):
        self.dir, self.master = None, master

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Named:
    def __init__(self, **settings):
        self.conf, self.sparkContext = Conf(settings), Context()


def test_the_named_folder_is_used():
    spark = Named(**{"spark.checkpoint.dir": "hdfs://shared/work"})
    assert session.shared_dir(spark) == "hdfs://shared/work"
    assert session.run_dir(spark, "x").startswith("hdfs://shared/work/peerlens-x-")
    assert session.run_dir(spark, "x") != session.run_dir(spark, "x")
    assert spark.sparkContext.dir is None


def test_own_folder_only_without_one():
    spark = Named()
    folder = session.shared_dir(spark)
    assert folder and session.shared_dir(spark) == folder == spark.sparkContext.dir


def test_a_cluster_must_name_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        spark = Named()
        spark.sparkContext.master = master
        with pytest.raises(RuntimeError):
            session.run_dir(spark, "x")


def test_cut_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "IF(id > 4, id, NULL) AS n", "struct(id AS a, cast(id AS string) AS b) AS s")
    copy = session.cut(df)
    assert copy.dtypes == df.dtypes and sorted(copy.collect()) == sorted(df.collect())
    assert session.cut(df.filter("id < 0")).count() == 0
