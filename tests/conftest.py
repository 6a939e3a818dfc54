import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kelk.session import get_spark

    session = get_spark(master="local[4]", memory="4g", shuffle_partitions=4)
    yield session
    session.stop()
