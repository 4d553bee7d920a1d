import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import build_session
    from tickloom.streaming.jobs import ROCKSDB

    s = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false",
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
