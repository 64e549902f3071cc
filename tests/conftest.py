import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from tidefolio.session import local_session

    return local_session(8, shuffle_partitions=4)


@pytest.fixture
def split(spark):
    """Force the plans for groups that do not fit one task."""
    from tidefolio.operators.groups import LIMIT_KEY

    spark.conf.set(LIMIT_KEY, "3")
    yield
    spark.conf.unset(LIMIT_KEY)
