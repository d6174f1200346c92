"""Streaks and changes that go over the ends of days, against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from sigmill.operators import health, watches


def moments(r, n, days):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return sorted({start + timedelta(minutes=r.randrange(days * 1440)) for _ in range(n)})


def test_streaks_go_over_days(spark):
    r = random.Random(1)
    rows = [(f"w{k}", t, r.random() < (0.5, 0.9, 0.99, 0.0)[k % 4]) for k in range(8) for t in moments(r, 60, 12)] + [("one", datetime(2024, 1, 5, tzinfo=timezone.utc), True)]
    want, streak = set(), {}
    for w, t, hit in sorted(rows):
        streak[w] = streak.get(w, 0) + 1 if hit else 0
        want.add((w, t.replace(tzinfo=None), hit, streak[w], hit and streak[w] == 3))
    got = watches.breach_runs(spark.createDataFrame(rows, "watch_id string, at timestamp, breached boolean"), 3)
    assert set(got.columns) == {"watch_id", "at", "breached", "consecutive", "alert"}
    assert {(x.watch_id, x.at.astimezone(timezone.utc).replace(tzinfo=None), x.breached, x.consecutive, x.alert) for x in got.collect()} == want


def test_changes_go_over_days_and_into_the_window(spark):
    r = random.Random(2)
    rows = [(f"c{k}", t, r.choice(["up", "up", "up", "down", "degraded"]), r.randrange(5), 200) for k in range(5) for t in moments(r, 80, 15)]
    rows += [("c0", t, "down", 9, 500) for _, t, *_ in rows[:3]]  # ties of time
    start, end = "2024-01-04 06:30:00", "2024-01-11 00:00:00"
    first, last = (datetime.fromisoformat(x).replace(tzinfo=timezone.utc) for x in (start, end))
    want, before = [], {}
    for c, t, ms, code, status in sorted((c, t, ms, code, s) for c, t, s, ms, code in rows):
        if first <= t <= last and before.get(c, status) != status:
            want.append((c, t.replace(tzinfo=None), before[c], status))
        before[c] = status
    df = spark.createDataFrame(rows, "check string, checked_at timestamp, status string, response_ms long, status_code int")
    got = health.transitions(df, start, end).collect()
    assert sorted((x.check, x.checked_at.astimezone(timezone.utc).replace(tzinfo=None), x.before, x.status) for x in got) == sorted(want) and want
