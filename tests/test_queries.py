"""Every query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# rows that the smallest tables do not contain
MAY_BE_EMPTY = {"j04_unique_path", "f13_predicate_chain", "r06_live_filter", "g01_callers", "g01_callees"}


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    if name in ORACLES:
        problem = compare(df, con, ORACLES[name])
        assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY), problem
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["user_id", "event_id", "ts_us", "n_recent"]


def test_every_inventory_id_has_a_query_or_a_unit_test():
    have = {name.split("_")[0] for name in contract.queries()}
    units = {"s09", "k07", "k08", "h01", "h02", "h03", "h05"}
    wanted = {
        *[f"s{i:02d}" for i in (1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13)], *[f"k{i:02d}" for i in range(1, 11)],
        *[f"f{i:02d}" for i in range(1, 33)], *[f"j{i:02d}" for i in range(1, 11)],
        *[f"a{i:02d}" for i in (*range(1, 19), 20)], *[f"w{i:02d}" for i in (*range(1, 12), 13, 14, 15)],
        *[f"t{i:02d}" for i in range(1, 11)], *[f"u{i:02d}" for i in range(1, 6)], *[f"x{i:02d}" for i in range(1, 24)],
        *[f"e{i:02d}" for i in range(1, 8)], "g01", "g02", "g03", *[f"r{i:02d}" for i in range(1, 8)],
        *[f"h{i:02d}" for i in range(1, 6)],
    }
    assert wanted - have - units == set()
