import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import hard_negatives as hn
from tests.llm.helpers import rows_of

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int, slot int, score double, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], SCHEMA)


def brute(rows, n_pos=5, n_neg=5, pct=80, every=100):
    known = []
    for i, v, y in rows:
        if None in (i, v, y) or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        known.append((i, (y + 1) % 10 if i % 7 == 0 else y, x))
    found = []
    anchors = {}
    for i, y, x in known:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, x)), (y, x))
    for a, (ya, xa) in anchors.items():
        scored = sorted((-sum(map(int.__mul__, xa, x)), i, y) for i, y, x in known if i != a)
        for p, i, _ in [r for r in scored if r[2] == ya][:n_pos]:
            near = [r for r in scored if r[2] != ya and pct * -p <= 100 * -r[0] <= 100 * -p][:n_neg]
            found += [(a, i, k, r[1], -p, -r[0]) for k, r in enumerate(near, 1)]
    return sorted(found, key=repr)


def vectors(rng, n, dim, labels=10, size=1.0):
    return [(i, [rng.uniform(-size, size) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def odd(rng):
    rows = vectors(rng, 900, 6)
    rows += [(200, None, 1), (300, [0.1] * 6, None), (None, [0.5] * 6, 1), (400, [float("nan")] * 6, 2),
             (401, [0.1, None, 0.2, 0.1, 0.1, 0.1], 2), (500, [float("inf")] * 6, 3), (600, [], 3),
             (700, [0.9], 4), (1000, [0.0] * 6, 1), (1100, [-0.5] * 6, 5), (1200, [2.0] * 9, 6)]
    copy = [rng.uniform(0, 1) for _ in range(6)]
    rows += [(1300 + i, copy, i % 3) for i in range(300)]  # ties
    rows += rows[:40] + [(100, [0.3] * 6, 7)]  # repeated rows, and an anchor of two kinds
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(1 << 18, 1 << 16), (64, 12)])
def test_odd_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", blocks[1])
    monkeypatch.setattr(hn, "TOGETHER", 2)
    rows = odd(random.Random(1))
    assert rows_of(hn.mine_embeddings(frame(spark, rows)), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("dim,labels,n_pos,n_neg,pct", [(3, 2, 3, 7, 100), (2, 10, 9, 2, 33), (8, 1, 5, 5, 80)])
def test_other_numbers(spark, dim, labels, n_pos, n_neg, pct):
    rows = vectors(random.Random(dim), 700, dim, labels)
    table = frame(spark, rows).select(
        F.col("vec_id").alias("id"), hn.swapped_label(F.col("vec_id"), F.col("label").cast("long")).alias("label"),
        hn.whole(F.col("embedding")).alias("vector"),
    )
    found = hn.mine(table, F.col("id") % 50 == 0, n_pos, n_neg, pct)
    assert rows_of(found, *COLUMNS) == brute(rows, n_pos, n_neg, pct, 50)


def test_numbers_beyond_exact_doubles(spark):
    rows = vectors(random.Random(2), 300, 3, 2, size=2.0**18)
    assert rows_of(hn.mine_embeddings(frame(spark, rows)), *COLUMNS) == brute(rows)


def test_few_keeps_the_best_and_ties():
    rng = np.random.default_rng(4)
    score, slot = rng.integers(-5, 6, (20, 400)), rng.integers(-1, 3, (20, 400))
    kept = hn.few(slot, score, 2)
    for i in range(20):
        for x in range(3):
            own = sorted(score[i][slot[i] == x])[::-1]
            assert sorted(score[i][kept[i] & (slot[i] == x)])[::-1] == [v for v in own if v >= own[1]]
    assert not kept[slot < 0].any()


def test_least_score():
    p = np.arange(0, 1000)
    for pct in (1, 33, 80, 100):
        assert (hn.least_score(p, pct) == [-(-x * pct // 100) for x in p.tolist()]).all()


def test_bad_percentage(spark):
    with pytest.raises(ValueError):
        hn.mine(spark.createDataFrame([], "id long, label long, vector array<long>"), F.lit(True), lower_pct=0)


def test_empty_table(spark):
    assert hn.mine_embeddings(frame(spark, [])).count() == 0


def test_plan_pairs_no_rows(spark):
    plan = hn.mine_embeddings(frame(spark, vectors(random.Random(5), 300, 3)))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
