import pytest

from loomway.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", cores=4, shuffle_partitions=4, memory="4g")
