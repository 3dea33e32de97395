import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from filigree.session import ensure_checkpoint_dir, local_session, ship

    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    ensure_checkpoint_dir(session)
    ship(session)
    yield session
    session.stop()
