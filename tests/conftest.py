import pytest

from mishaplens.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(cores="4", app="tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
