"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import compare
from laneflow.catalog import ORACLES, QUERIES

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not glob.glob(f"{compare.TESTDATA}/{SF}/*.parquet"), reason="no test tables")
# Six fits of each of 21 tree models with hundreds of trees: hours on one machine.  tests/test_models.py runs the same
# plan, all 30 models in five folds, with small trees.
LONG = {"e2_train_and_compare"}
MAY_BE_EMPTY = {"f04_filter_keys_timerange", "a09_group_speed_summary"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, shared_fixtures, name):
    if name in LONG and not os.environ.get("LANEFLOW_LONG"):
        pytest.skip("takes hours; set LANEFLOW_LONG to run it")
    verdict, n = compare.differences(spark, duck, name, SF)
    assert verdict == ("ok" if name in ORACLES else "rows only")
    assert n > 0 or name in MAY_BE_EMPTY


def test_every_inventory_id_has_a_query():
    families = {"s": 12, "f": 19, "j": 15, "a": 36, "w": 15, "t": 6, "u": 7, "x": 24, "m": 37, "r": 4}
    have = {name.split("_")[0] for name in QUERIES}
    assert not {f"{f}{i:02d}" for f, n in families.items() for i in range(1, n + 1)} - have
