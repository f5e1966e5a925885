import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from pagequarry.session import local_session

    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def segments(spark):
    """Build a segment table from {page: [text, ...]}."""

    def build(pages):
        rows = [(u, p, t, len(ts)) for u, ts in pages.items() for p, t in enumerate(ts)]
        return spark.createDataFrame(rows, "url string, pos bigint, text string, n_lines bigint")

    return build
