"""Adaptive conformal levels from counts against a plain fold over all scores."""

import math
import random

import pytest

from vintagepanel.operators import conformal


def plain(rows, alpha, gamma, min_cal):
    out, past, level = [], [], alpha
    for q in sorted({r[1] for r in rows}):
        own = [max(r[2] - r[4], r[4] - r[3]) for r in rows if r[1] == q]
        used, cut, n = level, 0.0, len(past)
        if n >= min_cal:
            k = math.ceil((n + 1) * (1 - level))
            cut = math.inf if k > n else sorted(past)[k - 1]
            level = min(0.6, max(0.01, level + gamma * (alpha - sum(s > cut for s in own) / len(own))))
        out.append((q, n, cut, used))
        past += own
    return out


@pytest.mark.parametrize(("bins", "few", "ties"), [(1024, 20_000, False), (4, 10, False), (4, 10, True), (16, 0, True)])
def test_schedule_equals_a_plain_fold(spark, bins, few, ties):
    rng = random.Random(bins + few)
    x = lambda: float(rng.choice([-1, 0, 0, 0, 2])) if ties else rng.gauss(0, 1)
    rows = [(f"e{i}", q, -0.5, 0.5, x()) for q in range(12) for i in range(rng.randint(5, 40))]
    df = spark.createDataFrame(rows, "entity string, qi long, q10 double, q90 double, y_true double")
    got = [tuple(r) for r in conformal.aci_schedule(df, 0.2, 0.1, 30, bins=bins, few=few).orderBy("qi").collect()]
    want = plain(rows, 0.2, 0.1, 30)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_jobs_follow_bins_not_quarters(spark):
    rng = random.Random(9)
    jobs = []
    for quarters in (10, 60):
        rows = [(q, float(rng.randint(0, 10_000))) for q in range(quarters) for _ in range(40)]
        counts = conformal.ScoreCounts(spark.createDataFrame(rows, "qi long, score double"), few=100_000)
        past = []
        for i in range(quarters):
            past += [s for q, s in rows if q == i]
            k = math.ceil(0.8 * len(past))
            assert counts.nodes[counts.kth(k, i + 1)].value == sorted(past)[k - 1]
        jobs.append(counts.jobs)
    assert jobs[0] == jobs[1] == 2
    assert conformal.aci_schedule(spark.createDataFrame([], "entity string, qi long, q10 double, q90 double, y_true double")).collect() == []
