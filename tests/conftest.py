import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import clear_materialised, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/millrace-warehouse"})
    yield session
    clear_materialised(session)
