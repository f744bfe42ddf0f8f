import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from labelscope.session import local_session

    session = local_session(os.environ.get("TEST_CORES", "4"), shuffle_partitions=4, memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))  # as a cluster has it
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows of a frame as a sorted list of tuples."""

    def collect(df, *columns):
        found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(found, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in r))

    return collect
