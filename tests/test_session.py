import pytest

from stelwerk import session as S


class _Session:
    """A session as far as shared_dir looks at it."""

    def __init__(self, master, at=None):
        self.set_to = at
        self.conf = self
        self.sparkContext = type("C", (), {"master": master, "getConf": lambda _: self})()

    def get(self, name, default=None):
        return self.set_to

    def set(self, name, value):
        self.set_to = value


def test_shared_folder():
    assert S.shared_dir(_Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local-cluster[3,2,1024]"):
        assert S.shared_dir(_Session(master)).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError):
            S.shared_dir(_Session(master))


def test_written_tables_are_read_from_the_shared_folder(spark):
    got = S.written(spark.range(5), "five")
    assert got.count() == 5 and S.shared_dir(spark) in got.inputFiles()[0]
