import pytest

from gridtide.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "gridtide-tests")
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session
