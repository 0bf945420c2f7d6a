import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slotledger.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from checks.inputs import Inputs

    return Inputs(spark, SF_DIR)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """The derived tables as files, logs split by day."""
    from checks.inputs import TEXTS, Inputs, store

    root = str(tmp_path_factory.mktemp("stored"))
    return store(Inputs(spark, SF_DIR), root, [n for n in TEXTS if n not in ("jobs_base", "jobs_crowded")])
