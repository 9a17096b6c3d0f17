import pytest

from riskloom.session import release
from tests.oracle import oracle_session


@pytest.fixture(scope="session")
def spark():
    session = oracle_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()
