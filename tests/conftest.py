import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent) + ":" + os.environ.get("PYTHONPATH", "")
    from tallyloom.session import local_session

    session = local_session(4, 4, "4g")
    yield session
    session.stop()
