import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledger_rows import Small  # noqa: E402
from tallyframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Small(spark)
