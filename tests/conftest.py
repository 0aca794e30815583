import datetime
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockyard import schema as S  # noqa: E402
from stockyard.session import build_session  # noqa: E402
from settings import SF_DIR  # noqa: E402



@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", "stockyard-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inventory(spark):
    from stockyard.sources import retail_star

    return retail_star.load(spark, SF_DIR)


DEFAULTS = {
    "date": datetime.date(2023, 5, 1), "store_id": "S001", "product_id": "P0001",
    "category": "Toys", "region": "North", "inventory_level": 100, "units_sold": 10,
    "units_ordered": 20, "demand_forecast": Decimal("50.00"), "price": Decimal("10.00"),
    "discount": 0, "weather_condition": "Sunny", "holiday_promotion": 0,
    "competitor_pricing": Decimal("9.50"), "seasonality": "Spring",
}


def money(value):
    return None if value is None else Decimal(str(value))


@pytest.fixture(scope="session")
def facts(spark):
    """Fact rows from dicts; columns not given take a default."""

    def make(*rows):
        full = []
        for row in rows:
            row = {**DEFAULTS, **row}
            for c in ("demand_forecast", "price", "competitor_pricing"):
                row[c] = money(row[c])
            if isinstance(row["date"], str):
                row["date"] = datetime.date.fromisoformat(row["date"])
            full.append(tuple(row[c] for c in S.FACT_COLUMNS))
        return spark.createDataFrame(full, S.FACT_SCHEMA)

    return make
