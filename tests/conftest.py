import pytest

from weftlink.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s
