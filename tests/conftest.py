import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from specmill import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


_LISTS = [n for n, t in schemas.RECORD_TYPES.items() if t.startswith("array")]


@pytest.fixture
def records(spark):
    """Builds a record table from partial dicts."""
    def make(*rows: dict):
        full = []
        for i, r in enumerate(rows):
            base = {n: None for n in schemas.RECORD_COLUMNS}
            base |= {n: [] for n in _LISTS} | {n: "" for n, t in schemas.RECORD_TYPES.items() if t == "string"}
            base |= {"batch_id": "b", "record_id": f"r{i}", "source_filename": f"f{i}.pdf", "_ocr_used": False, "_is_overview_image": False,
                     "packaging_notes": ("", "", "")} | r
            full.append(tuple(base[n] for n in schemas.RECORD_COLUMNS))
        return spark.createDataFrame(full, schemas.RECORD_DDL)
    return make
