from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarrymark.session import build_session

    session = build_session(
        "local[8]", driver_memory="6g", shuffle_partitions=8, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint"))
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from quarrymark.sources.tables import Tables

    return Tables(spark, DATA)
