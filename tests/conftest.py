import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
for folder in (HERE.parent, HERE):
    sys.path.insert(0, str(folder))

from depotlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="depotlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def stock(spark, sf):
    from depotlens.sources.tables import inventory

    return inventory(spark, sf).cache()
