from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starloom.session import ensure_checkpoint_dir, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", warehouse=str(tmp_path_factory.mktemp("warehouse")))
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
