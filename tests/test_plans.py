"""Plans hold at scale: no nested-loop joins, filters at the scan, early per-group limits, no key in one task."""

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# these run jobs when called (checkpoints, streams), so they are left out of the plan sweep
EAGER = {"g02_call_chain", "x02_coercion", "x03_nested_coercion", "s08_sampled_schema", "j09_module_use", "a12_module_counts", "t04_top_modules"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in EAGER and not n.startswith("r0")])
def test_no_nested_loops(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["f24_day_range"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text
    text = plan(contract.queries()["f17_predicates"](spark, SF))
    assert "PushedFilters: [Or(" in text and "ReadSchema: struct<o_orderkey" in text
    text = plan(contract.queries()["w02_trailing_alert"](spark, SF))
    assert "EqualTo(event_type,error)" in text and "value" not in text.split("ReadSchema")[1].split("\n")[0]


def test_first_per_file_is_cut_before_the_shuffle(spark):
    text = plan(contract.queries()["t09_first_per_file"](spark, SF))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["w02_trailing_alert", "w03_count_reset_alert", "w06_running_totals", "s03_line_numbers", "w07_tracebacks"])
def test_row_windows_are_split_by_chunk(spark, name):
    shuffles = [line for line in plan(contract.queries()[name](spark, SF)).split("\n") if "hashpartitioning" in line]
    # only the one-row-per-chunk summary is ever hashed by the key alone
    assert any("__chunk" in line for line in shuffles)
    alone = [line for line in shuffles if "__k0" in line and "__chunk" not in line and "__moment" not in line]
    assert len(alone) <= 1
