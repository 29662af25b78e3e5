import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flowlake.session import local_session
    session = local_session(4, "tests", "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def flows(spark):
    from flowlake import fixtures
    table = fixtures.flows(spark, SF).persist()
    table.count()
    return table


@pytest.fixture(scope="session")
def flow_frame(flows):
    return flows.orderBy("timestamp", "flow_id").toPandas()
