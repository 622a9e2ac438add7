"""Guard: no registered query plans a cross product or a nested-loop join, and
no plan gathers everything into one partition except over bounded tables."""

from colloquy.plans import suite

SMALL = "/root/testdata/sf0.001"


def test_no_cartesian_or_nested_loop(spark):
    bad = {}
    for name, q in suite.QUERIES.items():
        plan = q(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad
