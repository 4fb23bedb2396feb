import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from renalyze.session import get_session  # noqa: E402
from renalyze.streaming.state import STATE_CONF  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="renalyze-test-ckpt-")
    s = get_session("local[4]", app="renalyze-tests", shuffle_partitions=4,
                    extra={**STATE_CONF, "spark.checkpoint.dir": ckpt})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
