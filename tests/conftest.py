import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import get_session

    os.environ.setdefault("QUILL_DRIVER_MEMORY", "4g")
    os.environ.setdefault("QUILL_SHUFFLE", "4")
    s = get_session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
