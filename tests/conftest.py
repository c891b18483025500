import pytest

from tarn.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "6g", spark__sql__autoBroadcastJoinThreshold="1m")
    yield session
    session.stop()
