import pytest

from plumbgauge.session import build_session, stage_locally


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    stage_locally(session)
    yield session
    session.stop()
