"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vantidal.session import make_session

    shared = tmp_path_factory.mktemp("shared")
    extra = {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    session = make_session("local[4]", "tests", **extra)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
