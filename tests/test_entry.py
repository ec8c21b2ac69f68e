import sys

import __spark_entry__ as entry_points


def test_analytics_stand_alone(monkeypatch):
    """Without the training-data subpackage the other queries and oracles are still there."""
    monkeypatch.setitem(sys.modules, "tillscope.llm.queries", None)
    assert set(entry_points.queries()) == set(entry_points.analytics()) == set(entry_points.oracle_sql())
