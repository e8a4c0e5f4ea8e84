import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from fixgrain.runtime import local_session, ship

    session = local_session(2, **{"spark.sql.shuffle.partitions": "2"})
    ship(session)
    yield session
    session.stop()
