import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from plurispark.session import build_session

    session = build_session("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
