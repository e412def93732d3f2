import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from fieldlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    def sort(df, *cols):
        return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)

    return sort
