import pytest

from lumengrid.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    yield session
    session.stop()
