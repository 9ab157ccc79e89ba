"""Every registered query against its SQL on the small tables."""
import pytest

from plumbline import catalog
from tests import oracle

ROOT = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(ROOT)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, ROOT, name) is None
