import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
os.environ["TZ"] = "UTC"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stelwerk.session import session

    at = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{at}", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(at / "warehouse")}
    s = session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """rows(df) -> sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
