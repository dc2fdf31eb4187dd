"""The registered bootstrap resamples as often as the operator's default."""

import inspect

from strideway.operators import stats
from strideway.plans import catalog


def test_registered_with_the_default(spark, data, monkeypatch):
    real, seen = stats.bootstrap_ci, []

    def spy(*args, **kw):
        bound = inspect.signature(real).bind(*args, **kw)
        bound.apply_defaults()
        seen.append(bound.arguments["reps"])
        return real(*args, **kw)

    monkeypatch.setattr(stats, "bootstrap_ci", spy)
    catalog.bootstrap_ci(spark, data)
    assert seen == [2000]
