"""What the registered queries ask of their operators."""

from rankweave.operators import significance
from rankweave.plans import registry


def test_the_bootstrap_has_the_operators_default(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(significance, "bootstrap_ci", lambda d, iterations=significance.ITERATIONS: asked.append(iterations) or d)
    registry.queries()["bootstrap_ci"](spark, small)
    assert asked == [significance.ITERATIONS] == [10_000]
