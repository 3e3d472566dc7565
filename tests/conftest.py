import pytest

from pluvia.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, app="tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.sql.maxMetadataStringLength": "10000"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
