import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(autouse=True)
def no_settings(monkeypatch):
    """Tests don't depend on the keys and settings of the machine."""
    import os

    for name in [n for n in os.environ if n.startswith("TESSERA_") or n in ("GEMINI_API_KEY", "OPENAI_API_KEY", "ANTHROPIC_API_KEY")]:
        monkeypatch.delenv(name)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """A DataFrame from dictionaries, with a schema in text."""

    def make(data, schema):
        names = [x.split()[0] for x in schema.split(", ")]
        return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schema)

    return make
