import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spindrift.plans.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.enabled", "true")
    yield s


@pytest.fixture(scope="session")
def tiny():
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("the test tables aren't here")
    return d
