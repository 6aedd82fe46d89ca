import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from docpairs.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    # Tests own their session, so they may name a scratch checkpoint folder.
    scratch = tempfile.mkdtemp(prefix="docpairs-test-ckpt-")
    s.sparkContext.setCheckpointDir(scratch)
    yield s
    s.stop()
    shutil.rmtree(scratch, ignore_errors=True)
