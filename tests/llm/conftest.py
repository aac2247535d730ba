from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def awkward(spark):
    import corpus_cases

    return corpus_cases.frame(spark, corpus_cases.awkward())


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
