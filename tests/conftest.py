import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from topicgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Many tiny jobs: few partitions, and no time spent compiling plans.
    session = local_session(
        8,
        "6g",
        **{
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
            "spark.sql.shuffle.partitions": "3",
            "spark.sql.codegen.wholeStage": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "state")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
