import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallybook.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = configure(SparkSession.builder.master("local[4]").appName("tallybook-tests"))
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def statement(spark):
    """A small categorized ledger with ids: 3 months, several categories."""
    from tallybook.operators.categorize import with_category
    from tallybook.operators.clean import clean_ledger
    from tallybook.operators.identity import with_txn_id

    rows = []
    for month in (1, 2, 3):
        rows += [
            (f"2026-{month:02d}-03", "SALARY CREDIT - ACME", "62000.00"),
            (f"2026-{month:02d}-04", "BIGBASKET - WEEKLY", f"-{1800 + month}.50"),
            (f"2026-{month:02d}-05", "OLA CABS", "-180"),
            (f"2026-{month:02d}-05", "OLA CABS", "-180"),
            (f"2026-{month:02d}-06", "PAYMENT REF 77", "-20"),
        ]
        rows += [(f"2026-{month:02d}-{day:02d}", "NETFLIX", "-199") for day in range(10, 15)]
    rows += [("2026-01-08", "SWIGGY DINNER", "-420"), ("2026-03-08", "SWIGGY LUNCH", "-490")]
    raw = spark.createDataFrame(rows, "date string, description string, amount string")
    return with_txn_id(with_category(clean_ledger(raw))).cache()
