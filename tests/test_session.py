import os

import pytest

from tickloom.session import release_staged, shared_root, stage


def test_staged_table_is_a_copy_in_the_named_folder(spark):
    df = stage(spark.range(10).withColumnRenamed("id", "x"), "unit")
    assert df.count() == 10
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") in df.inputFiles()[0]


class FakeContext:
    """A context without the setting; the JVM one cannot be changed in a running session."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"{folder}/run"


class FakeSession:
    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    def __init__(self, context):
        self.sparkContext = context


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError):
        shared_root(FakeSession(FakeContext("yarn")))
    assert shared_root(FakeSession(FakeContext("yarn", "hdfs://x/y"))) == "hdfs://x/y"


def test_local_session_gets_one_folder():
    session = FakeSession(FakeContext("local[2]"))
    assert shared_root(session) == shared_root(session)


def test_release_removes_what_was_staged(spark):
    path = stage(spark.range(3), "unit").inputFiles()[0]
    folder = os.path.dirname(path.removeprefix("file://").removeprefix("file:"))
    assert os.path.isdir(folder)
    release_staged(spark)
    assert not os.path.isdir(folder)
    assert stage(spark.range(3), "unit").count() == 3
