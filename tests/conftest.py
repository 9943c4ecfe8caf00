import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from forkline.session import local_session, scratch_scope


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    with scratch_scope(session):
        yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_tables_left(request):
    """Intermediate tables go with the test that stored them."""
    if "spark" not in request.fixturenames:
        yield
        return
    with scratch_scope(request.getfixturevalue("spark")):
        yield
