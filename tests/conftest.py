import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from convoweave.session import get_session

    session = get_session("tests", cores="4", shuffle_partitions=4)
    yield session
    session.stop()
