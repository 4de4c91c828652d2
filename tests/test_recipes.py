"""Recipes against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import recipes


@pytest.mark.parametrize("seconds", [0, 10, 3600])
def test_moving_average(spark, seconds):
    rng = random.Random(seconds)
    base = datetime(1969, 12, 31, 23, 0)
    step = max(1, seconds // 4)
    rows = [(n, rng.choice(["a", "b", None]), base + timedelta(seconds=step * rng.randrange(120)), rng.choice([None, *range(9)])) for n in range(600)]
    rows += [(600, "a", None, 3), (601, "a", None, 4), (602, "b", base, 1)]
    df = spark.createDataFrame(rows, "id long, tag string, ts timestamp_ntz, v long")
    got = recipes.moving_average(df, ["tag"], "ts", "v", seconds)
    assert got.columns == ["id", "tag", "ts", "v", "moving_avg"]
    found = {r.id: r.moving_avg for r in got.collect()}
    assert len(found) == got.count() == len(rows)
    for n, tag, ts, _ in rows:
        near = [v for _, t, at, v in rows if t == tag and v is not None and ((at is None) if ts is None else (at is not None and timedelta(0) <= ts - at <= timedelta(seconds=seconds)))]
        assert found[n] == pytest.approx(sum(near) / len(near)) if near else found[n] is None
    assert recipes.moving_average(df.limit(0), ["tag"], "ts", "v", seconds).count() == 0
