import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pairmill.session import local_session
    ckpt = tempfile.mkdtemp(prefix="pairmill-ckpt-")
    s = local_session(cores=4, shuffle_partitions=8, app="pairmill-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="pairmill-wh-")})
    from pairmill.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s, fallback=ckpt)  # only used when the environment names none
    yield s
    s.stop()
