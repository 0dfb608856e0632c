import pytest

from tillflow.schema import EXPECTED_COLUMNS, RAW_HEADERS, WAREHOUSE_SCHEMA
from tillflow.session import local_session

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(cores=8, memory="8g", shared_folder=str(folder / "shared"), warehouse_folder=str(folder / "warehouse"))
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def change(**settings):
        for name, value in settings.items():
            name = name.replace("__", ".")
            before.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, str(value))

    yield change
    for name, value in before.items():
        spark.conf.set(name, value)


ORDER_LINE = dict(zip(RAW_HEADERS, (
    "1", "QX-2017-000417", "3/14/2017", "3/17/2017", "Standard Class", "OQ-00031", "Ora Quill", "Corporate",
    "Norland", "Eastmere", "Highshire", "90417", "North", "TOY-KI-00000077", "Toys", "Kites",
    "Twin-Line Kite, Blue", "184.50", "3", "0.05", "28.6042",
)))


@pytest.fixture
def raw(spark):
    """Raw text rows from changes to one order line."""

    def build(*changes):
        rows = [tuple((ORDER_LINE | c).values()) for c in changes]
        return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in RAW_HEADERS))

    return build


@pytest.fixture
def warehouse(spark):
    """Warehouse rows from dictionaries; columns not named are NULL."""

    def build(*rows):
        return spark.createDataFrame([tuple(r.get(c) for c in EXPECTED_COLUMNS) for r in rows], WAREHOUSE_SCHEMA)

    return build
