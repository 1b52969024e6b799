import pytest

from tablesync import build_session


@pytest.fixture(scope="session")
def spark():
    # A zone with summer time: no result may depend on the session zone.
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "3",
            "spark.default.parallelism": "2",
            "spark.sql.session.timeZone": "America/New_York",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df, *columns):
        data = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(data, key=lambda r: tuple((v is not None, str(v)) for v in r))

    return collect
