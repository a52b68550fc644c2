from __future__ import annotations

import pytest

from rivetwatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(partitions=4, name="rivetwatch-tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
