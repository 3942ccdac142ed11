"""Metrics of random snapshots against a plain-Python calculator."""

import random
from datetime import date, timedelta

import pytest

from snapledger.operators import metrics, staging

STATUSES = ["done", "in_progress", "todo", "Done", " todo "]


def snapshot(seed, n=300):
    rng = random.Random(seed)
    return [
        (f"R{i:04d}", f"P{rng.randint(1, 4)}", f"n{i}", f"O{rng.randint(1, rng.randint(2, 15))}",
         date(2026, 9, 15) + timedelta(days=rng.randint(-40, 40)), rng.choice(STATUSES))
        for i in range(n)
    ]


def calculate(rows, ref):
    late = [r for r in rows if r[5] != "done" and r[4] < ref]
    done = sum(r[5] == "done" for r in rows)
    still = len(rows) - done
    return (len(rows), done, still, len(late), still - len(late), len({r[3] for r in late}),
            done / len(rows) if rows else 0.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_metrics_equal_the_calculator(spark, seed):
    rows = snapshot(seed)
    names = ["action_id", "project_name", "action_name", "owner", "due_date", "status"]
    df = spark.createDataFrame(rows, names)
    dates = [date(2026, 8, 1), date(2026, 9, 15), date(2026, 9, 16), date(2026, 12, 1)]
    swept = {r.reference_date: r for r in staging.sweep_reference_dates(df, dates).collect()}
    for ref in dates:
        facts = staging.with_flags(df, ref)
        assert tuple(metrics.portfolio(facts).first()) == calculate(rows, ref)
        s = swept[ref]
        assert (s.total_actions, s.completed_actions, s.open_actions, s.overdue_actions,
                s.open_not_overdue_actions, s.owners_with_overdue_actions) == calculate(rows, ref)[:6]
        per = {r.project_name: r for r in metrics.by(facts, ["project_name"], owners=True).collect()}
        for p, r in per.items():
            part = [x for x in rows if x[1] == p]
            assert tuple(r[c] for c in (*metrics.ADDITIVE, "owners_with_overdue_actions", "completion_rate")) \
                == calculate(part, ref)
        detail = metrics.overdue_detail(facts).collect()
        want = sorted((x for x in rows if x[5] != "done" and x[4] < ref),
                      key=lambda x: (-(ref - x[4]).days, x[4], x[0]))
        assert [(d.action_id, d.days_overdue) for d in detail] == [(x[0], (ref - x[4]).days) for x in want]
