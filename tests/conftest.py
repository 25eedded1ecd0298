import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clearlane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # plans are read as text: late in a session column ids are longer, and 100 characters, the usual limit, cut the filters off
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.maxMetadataStringLength": "2000"}
    session = local_session(8, "clearlane-tests", **settings)
    yield session
    session.stop()
