import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    def whole(v):
        return [max(-negatives.LIMIT, min(negatives.LIMIT, int(np.floor(256 * float(np.float32(x)))))) for x in v]

    fine = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    fine = sorted({(i, tuple(whole(v)), label) for i, v, label in fine}, key=lambda r: (r[0] is not None, r[0] or 0, r))
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = []
    for a in fine:
        if a[0] is None or a[0] % every:
            continue
        ranked = sorted(((-score(a, b), b[0] is not None, b[0] or 0, b) for b in fine if b is not a), key=lambda x: x[:3])
        for p in [x for x in ranked if x[3][2] == a[2]][:5]:
            ok = [x for x in ranked if x[3][2] != a[2] and 30 * p[0] >= 100 * x[0] >= 90 * p[0]][:10]
            out += [(a[0], p[3][0], n, x[3][0], -p[0], -x[0]) for n, x in enumerate(ok, 1)]
    return sorted(out, key=str)


def clustered(rng, n, dim=8, clusters=6, spread=0.08):
    centres = rng.normal(0, 1, (clusters, dim))
    points = centres[rng.integers(clusters, size=n)] * rng.uniform(0.4, 1, (n, 1)) + rng.normal(0, spread, (n, dim))
    return [(i, points[i].astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block, leaf, anchors", [(8192, 64, 4096), (64, 4, 3), (7, 1, 100)])
def test_equal_to_brute_force(spark, block, leaf, anchors):
    rng = np.random.default_rng(block)
    rows = clustered(rng, 600)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(300)]  # one vector many times
    got = found(negatives.mine(spark.createDataFrame(rows, VECTORS), 20, block, anchors, leaf))
    assert got == brute(rows, 20) and got


def test_odd_input(spark):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 80)
    rows += [(200, None, 1), (None, None, 1), (200, [1.0, None], 1), (300, [float("nan")] * 8, 1), (400, [float("inf")] * 8, 2), (100, rows[3][1], None)]
    rows += [rows[0], rows[0], (0, rows[9][1], 1), (None, rows[5][1], 2), (500, [], 0), (600, [0.5], 1), (700, [0.0] * 8, 1), (800, [0.0] * 8, 1)]
    rows += [(900, [-1.0] * 8, 3), (901, [1.0] * 8, 3)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("vec", "score", "slot", "rank", "cell")})
    assert found(negatives.mine(frame)) == brute(rows)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 3e4, 6) if i % 9 else rng.normal(0, 1e9, 6)).astype(np.float32).tolist(), i % 3) for i in range(60)]
    assert found(negatives.mine(spark.createDataFrame(rows, VECTORS), 10, 16, 8, 4)) == brute(rows, 10)


def test_empty_table(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []


def test_nodes_cover_their_rows():
    points = np.random.default_rng(2).normal(size=(700, 5))
    order, nodes = negatives.build(points, 8)
    assert sorted(order) == list(range(700))
    moved = points[order]
    for centre, low, high, radius, first, count in nodes:
        inside = moved[int(low) : int(high)]
        assert np.sqrt(((inside - moved[int(centre)]) ** 2).sum(1)).max() <= radius + 1e-9
        children = nodes[int(first) : int(first + count)]
        if count:
            assert children[0][1] == low and children[-1][2] == high and (children[1:, 1] == children[:-1, 2]).all()
        else:
            assert high - low <= 8


def test_nodes_outside_the_window_are_skipped():
    rng = np.random.default_rng(3)
    rows = clustered(rng, 4000, clusters=40, spread=0.01)
    vecs = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int32)
    labels, top = np.array([r[2] for r in rows], np.int32), float((vecs.astype(float) ** 2).sum(1).max())
    order, nodes = negatives.build(negatives.augmented(vecs, top), 16)
    ids = np.arange(4000)
    one = lambda v: np.array([v], np.int64)
    score = int((vecs[0].astype(np.int64) ** 2).sum())
    asked = negatives.Asked(one(0), labels[:1], vecs[:1], one(0), one(score * 85 // 100), one(score * 90 // 100), 10, False)
    run = negatives.Search(asked, vecs[order[:1]], top)
    verified = run.walk(0, 0.0, 1e9, ids[order], labels[order], vecs[order], nodes)
    assert verified < 1000
    scores = vecs.astype(np.int64) @ vecs[0].astype(np.int64)
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if labels[i] != labels[0] and asked.low[0] <= s <= asked.high[0])[:10]
    assert list(zip((-run.best.scores[0]).tolist(), run.best.ids[0].tolist()))[: len(want)] == want
