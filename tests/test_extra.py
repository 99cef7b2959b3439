import re

from gutterline.plans.registry import QUERIES


def test_no_sketch_goes_with_every_value(spark, sf):
    """The estimate's sketch is kept for each flag, not for each flag and part."""
    from gutterline.plans import extra_queries  # noqa: F401

    plan = QUERIES["extra_distinct_estimate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by_part = [line for line in plan.splitlines() if re.search(r"keys=\[[^\]]*l_partkey", line)]
    assert by_part and not any("approx_count_distinct" in line for line in by_part)
