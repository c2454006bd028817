import pytest

from assetlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
