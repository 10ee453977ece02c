import pytest

from boardlake.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[8]", 4, **{"spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def values(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)
