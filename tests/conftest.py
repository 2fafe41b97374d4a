import pytest

from colloquy.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g", **{"spark__sql__shuffle__partitions": "4"})
    yield session
    session.stop()
