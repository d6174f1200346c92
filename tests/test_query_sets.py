"""Sets of anchors and traces can be of any size."""

from __future__ import annotations

import pytest

from sigmill.plans import registry


@pytest.mark.parametrize("name", ["srt4_log_context", "trc5_trace_context"])
def test_no_broadcast_is_forced(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan


def test_every_row_is_asked_for_a_suggestion(spark):
    plan = registry.queries()["ing11_suggest_field"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Deduplicate") + plan.count("Distinct") == 1
    assert plan.lstrip().startswith(("Deduplicate", "Distinct", "Aggregate"))
