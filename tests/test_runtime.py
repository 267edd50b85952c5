"""The folder for tables between steps: the session's own setting, or an error on a cluster that has none."""

import pytest

from ledgerline import runtime
from ledgerline.errors import AnalyticsError


class _Conf:
    def get(self, name, default=None):
        return default


class _Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, master):
        self.conf, self.sparkContext = _Conf(), _Context(master)


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(AnalyticsError, match="spark.checkpoint.dir"):
            runtime._shared_dir(_Session(master))


def test_one_process_gets_a_folder_of_its_own():
    assert runtime._shared_dir(_Session("local[2]")) == runtime._shared_dir(_Session("local[4]"))


def test_settled_tables_go_when_they_are_released(spark):
    import os

    table = runtime.settle(spark.range(5).toDF("x"), "trial")
    assert table.count() == 5
    root = runtime._root(spark).removeprefix("file://")
    assert os.path.isdir(root)
    runtime.release(spark)
    assert not os.path.isdir(root)
