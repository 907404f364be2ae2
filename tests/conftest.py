import os
from pathlib import Path

import pytest

from driftline.session import build_session, ship

HERE = Path(__file__).resolve().parent


@pytest.fixture(scope="session")
def spark():
    # workers import the tests' own functions
    os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), str(HERE / "llm"), str(HERE.parent), os.environ.get("PYTHONPATH", "")])
    s = build_session("local[4]", 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)
