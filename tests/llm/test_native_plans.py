"""The operators that must stay in the JVM do."""

import re

import pytest

from bitgrove.llm import base, exact_dedup, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [exact_dedup.op6_exact_dedup, pii.op5_pii])
def test_no_python_on_the_way(spark, query, monkeypatch):
    plans = []

    def spy(df, label, narrow=False, write=base.materialise):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, narrow)

    for module in (exact_dedup, pii):
        monkeypatch.setattr(module, "materialise", spy)
    df = query(spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2
    assert not any(re.search("Python|ArrowEval|MapInArrow|MapInPandas|CartesianProduct|BroadcastNestedLoop", p) for p in plans)
