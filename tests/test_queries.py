"""Every registered query with an oracle against DuckDB on the smallest data folder."""

import warnings
from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import check
from checks.oracle import oracle_sql
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


#: Fitted numbers no SQL can give; tests/test_training.py and tests/test_trend.py hold them against planted signals.
FITTED = {"occupancy_forecasts", "attendance_forecasts", "waiting_forecasts", "workforce_forecasts", "gbt_backtest"}


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) - set(oracle_sql()) == FITTED


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = check(spark, FOLDER, name, oracle_sql()[name])
    assert result.startswith("ok"), result
