import pytest

from ledgerlens.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", "local[*]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
