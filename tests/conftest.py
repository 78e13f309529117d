import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import build_session

    scratch = tempfile.mkdtemp(prefix="tillroll-test-")
    session = build_session(
        master="local[4]",
        app_name="tillroll-tests",
        shuffle_partitions=4,
        extra={
            "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            "spark.sql.warehouse.dir": os.path.join(scratch, "wh"),
            "spark.driver.memory": "4g",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="tillroll-out-")
