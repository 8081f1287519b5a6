import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(4, **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "3g"})
    yield s
    s.stop()
