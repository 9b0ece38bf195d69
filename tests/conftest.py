import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    s = session(4)
    s.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    yield s
    s.stop()
