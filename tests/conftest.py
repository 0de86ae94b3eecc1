import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shoplattice.session import build_session
    s = build_session("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from shoplattice.sources.tables import Tables
    return Tables(spark, DATA)
