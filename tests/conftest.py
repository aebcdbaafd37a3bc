import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from glossmill.context import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, shuffle_partitions=4)
    yield s
    s.stop()
