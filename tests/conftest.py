import pytest

from lodestone.session import session


@pytest.fixture(scope="session")
def spark():
    return session("lodestone-tests", "4", spark__sql__shuffle__partitions="4")
