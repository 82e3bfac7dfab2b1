import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foldstone.session import BLOCK_ROWS_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of three positions, so that one stream spans many of them."""
    spark.conf.set(BLOCK_ROWS_CONF, "3")
    yield
    spark.conf.unset(BLOCK_ROWS_CONF)
