import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillscope.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from tillscope.sources.orderlines import star_view

    return star_view(spark, SMALL)


@pytest.fixture(scope="session")
def raw(spark):
    from tillscope.sources.orderlines import raw_feed

    return raw_feed(spark, SMALL)
