import pytest

from cairn.session import session, shared_root, ship


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 8)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    shared_root(s)
    yield s
    s.stop()
