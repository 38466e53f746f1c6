import pytest

from docdrift.session import ship_package


@pytest.fixture(scope="session")
def llm(spark):
    """The session with the package on the Python workers."""
    ship_package(spark)
    return spark
