"""Mutual information by nearest neighbours against its definition."""

import math
import random

import pytest

from flowloom.operators.records import digamma, neighbour_information

GAMMA = 0.5772156649015329


def psi(n):
    return sum(1 / i for i in range(1, n)) - GAMMA


def brute(rows, k=3):
    rows = [(x, y) for x, y in rows if x is not None and math.isfinite(x)]
    rows = [(x, y) for x, y in rows if sum(z == y for _, z in rows) > 1]
    total = 0.0
    for i, (x, y) in enumerate(rows):
        same = sorted(abs(a - x) for j, (a, b) in enumerate(rows) if j != i and b == y)
        want = min(k, len(same))
        d = same[want - 1]
        if d == 0:
            want, m = same.count(0), sum(a == x for a, _ in rows) - 1
        else:
            m = sum(abs(a - x) < d for a, _ in rows)
        total += psi(want) - psi(len(same) + 1) - psi(m)
    return max(psi(len(rows)) + total / len(rows), 0)


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_equal_to_the_definition(spark, blocks):
    rng = random.Random(blocks)
    label = [rng.choice("aaab") for _ in range(250)] + ["alone", "two", "two"]
    shifted = [float(rng.randrange(40)) + 30 * (y == "b") for y in label]
    noise = [rng.choice([0.0, 0.0, 1.0, 2.5, None, math.nan, math.inf, float(rng.randrange(1000))]) for _ in label]
    code = [float(y == "b") for y in label]
    frame = spark.createDataFrame(list(zip(label, shifted, noise, code)), "y string, shifted double, noise double, code double")
    found = {r.feature: r.score for r in neighbour_information(frame, ["shifted", "noise", "code"], "y", blocks=blocks).collect()}
    for name, values in (("shifted", shifted), ("noise", noise), ("code", code)):
        assert found[name] == pytest.approx(brute(list(zip(values, label))), abs=1e-9)
    assert found["shifted"] > found["noise"]


def test_digamma(spark):
    ns = [1, 2, 3, 10, 1000, 10**6]
    frame = spark.createDataFrame([(n,) for n in ns], "n long")
    found = {r[0]: r[1] for r in frame.select("n", digamma(frame.n.cast("double"))).collect()}
    assert all(found[n] == pytest.approx(psi(n), abs=1e-11) for n in ns)
