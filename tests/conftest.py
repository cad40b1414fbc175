"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from coursemill.session import local_session, ship_package

    session = local_session(4, 4)
    ship_package(session)
    yield session


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    return str(DATA)
