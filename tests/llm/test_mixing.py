import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pluvia.llm import mixing
from tests.llm.helpers import frame, odd_rows, rows_of, sentence, words


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Shares by weight; what is over a source's cap is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        over = sum(weight[s] for s in order if s not in capped)
        share = {
            s: most * sizes[s] if s in capped else Fraction(left * weight[s], over or 1) for s in order
        }
        new = {s for s in order if s not in capped and share[s] > most * sizes[s]}
        if not new:
            return {s: float(x) for s, x in share.items()}
        capped |= new


def corpus(seed: int, sources: int = 7):
    rng = random.Random(seed)
    return [
        (i, sentence(rng, rng.choice([0, 3, 40, 400])), "aa", rng.choice([None, *[f"s{k}" for k in range(sources)] + ["s0"] * 5]))
        for i in range(400)
    ]


@pytest.mark.parametrize("rows", [odd_rows(), corpus(1), corpus(2, 30)], ids=["odd", "some", "many"])
def test_targets_and_taken(spark, rows):
    docs = frame(spark, rows)
    got = mixing.plan(docs, shard_words=4000).collect()
    sizes: Counter = Counter()
    by_id = {}
    for i, text, _, source in rows:
        sizes[source] += len(words(text))
        by_id.setdefault(i, set()).add(len(words(text)))
    want = targets(sizes)
    assert len(got) == len(rows)
    taken, told = Counter(), set()
    for r in got:
        assert r["size"] in by_id[r.doc_id]
        assert 0 <= r.taken <= 3 * r["size"]
        told.add((r.source_size, round(r.target, 6)))
        taken[round(r.target, 6), r.source_size] += r.taken
    assert told == {(sizes[s], round(t, 6)) for s, t in want.items()}
    block = max(1, min(sum(sizes.values()) // (256 * len(sizes)), 1024))
    for (target, size), words_taken in taken.items():
        same = sum(1 for s in sizes if (sizes[s], round(want[s], 6)) == (size, target))
        assert abs(words_taken - same * target) <= same * (2 * block + 0.03 * target + 2)


def test_reruns_agree(spark):
    docs = frame(spark, odd_rows())
    columns = ("doc_id", "size", "target", "taken")
    assert rows_of(mixing.plan(docs), *columns) == rows_of(mixing.plan(docs.repartition(7)), *columns)


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100, 1000):
        votes = {i: rng.choice([0.0, 1.0, 5.5, rng.random() * 900]) for i in range(25)}
        parties = spark.createDataFrame(list(votes.items()), "no int, votes double").withColumn(
            "seats", F.lit(seats)
        )
        got = mixing.apportioned(parties, "votes", "seats", F.lit(10**6), [], "no").collect()
        heap: dict = defaultdict(int)
        for _ in range(seats):
            heap[max(votes, key=lambda i: (votes[i] / (2 * heap[i] + 1), -i))] += 1
        assert {r.no: r.won for r in got} == {i: heap[i] for i in votes}


def in_order(some, every):
    return all(w in every for w in some)


def test_mixed_texts_have_the_words_taken(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns
    want: Counter = Counter()
    for r in mixing.plan(docs).collect():
        want[r.doc_id] += r.taken
    got: Counter = Counter()
    texts = defaultdict(set)
    for i, text, *_ in rows:
        texts[i].add(text)
    for r in kept.collect():
        got[r.doc_id] += len(words(r.text))
        # In order, at most with a gap where the run of blocks starts anew at the shard's start.
        assert any(in_order(words(r.text), iter(words(t))) for t in texts[r.doc_id])
    assert got == +want


def test_empty_table_and_empty_texts(spark):
    assert mixing.plan(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [])).count() == 0
    nothing = [(1, None, "a", "s"), (2, "", "a", None)]
    assert rows_of(mixing.plan(frame(spark, nothing)), "doc_id", "size", "target", "taken") == [
        (1, 0, 0.0, 0), (2, 0, 0.0, 0)
    ]
    assert mixing.mixed(frame(spark, nothing)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mixed(frame(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tiny_sources_beside_large_ones_meet_their_targets(spark):
    """The average source has 256 blocks of 1,024 words; the small ones still get their words."""
    sizes = {"a": 170, "b": 400, "c": 600, "d": 1600, "e": 1, "f": 900_000, "g": 1_200_000}
    parts = [(s, k) for s, n in sizes.items() for k in [n // 100] * 100 + [n % 100]]
    table = spark.createDataFrame(
        [(i, k, s) for i, (s, k) in enumerate(parts)], "doc_id long, k int, source string"
    ).selectExpr("doc_id", "trim(repeat('w ', k)) text", "source")
    want = {sizes[s]: t for s, t in targets(sizes).items()}
    got = mixing.plan(table).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"))
    found = got.collect()
    assert len(found) == len(want)
    for r in found:
        assert abs(r.target - want[r.source_size]) < 1e-6 * r.target
        assert abs(r.taken - r.target) <= 0.01 * r.target + 1
