import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera import session

    ck = tempfile.mkdtemp(prefix="tessera-test-ckpt-")
    s = session.build("local[4]", "tessera-tests", {"spark.sql.shuffle.partitions": "8",
                                                    "spark.sql.session.timeZone": "America/New_York",
                                                    "spark.checkpoint.dir": ck})
    yield s
    s.stop()
