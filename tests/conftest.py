import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from fluvia.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship(session("tests", 4, spark__sql__shuffle__partitions="4"))
