import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomspark.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="loom-test-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
