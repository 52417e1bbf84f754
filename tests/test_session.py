"""Scratch tables go when the session's owner says so."""

import os

from msgrisk import session
from msgrisk.operators import scans


def test_scratch_is_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    df = spark.range(100).selectExpr("id", "id % 3 = 0 AS take")
    rows = scans.last_before(df, "id", df["id"], df["take"], "before").collect()
    assert len(rows) == 100
    made = list(session._scratch)
    assert made and all(os.path.isdir(p) for p in made)
    assert session.clear_scratch(spark) == len(made) and session.clear_scratch(spark) == 0
    assert not any(os.path.exists(p) for p in made)
