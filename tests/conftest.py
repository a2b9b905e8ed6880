import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = f"{HOME}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from weftline.session import session

    s = session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
