import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from plotweave.session import build_session, tune

    session = build_session("tests", "local[*]", spark__ui__enabled="false", spark__driver__memory="8g", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()
