"""Plan checks: no cartesian products or nested-loop joins; filters pushed down."""

import pytest

import __spark_entry__ as E
from telewatch.plans.registry import entries

from .conftest import SF001

SLOW = {"m12_model_comparison", "m12_model_properties", "s15_model_round_trip", "r5_model_level", "r5_served_properties"}
NAMES = set(entries())         # the training-data queries have their own tests


def plan_text(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(NAMES - SLOW))
def test_no_cross_products(spark, name):
    text = plan_text(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_date_filter_reaches_the_scan(spark):
    text = plan_text(E.queries()["q6_date_range"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text


def test_report_aggregates_before_the_shuffle(spark):
    text = plan_text(E.queries()["q8_report_by_system"](spark, SF001))
    assert text.count("HashAggregate") >= 2  # partial + final
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double,props:string>" in text
