import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.streaming.entity_features import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "ledgerlens-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__python__unix__domain__socket__enabled="true",
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
