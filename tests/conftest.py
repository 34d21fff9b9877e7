import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from threadloom.session import local_session  # noqa: E402

# columns can only be built while a session is active, and tests build them as parameters
SESSION = local_session(4, shuffle_partitions=4, memory="4g")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
