"""No query plans a cartesian product or a nested-loop join, and scans read only what they need."""
import contextlib
import io

import pytest

from corrobora.plans.catalog import load_all

SF = "/root/testdata/sf0.001"
NAMES = list(load_all())


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_joins(spark, name):
    text = plan(load_all()[name].run(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_column_pruning_and_pushdown(spark):
    from corrobora.plans.views import Tables
    from corrobora.operators.evidence import evidence_tiers
    t = Tables(spark, SF)
    text = plan(evidence_tiers(t.v_assertions))
    assert "l_extendedprice" not in text and "l_comment" not in text
    assert "PushedFilters: [IsNotNull(s_suppkey)" in text or "IsNotNull(s_suppkey)" in text
