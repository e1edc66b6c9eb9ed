import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from lumenstep.llm import common

    common.ship(spark)
