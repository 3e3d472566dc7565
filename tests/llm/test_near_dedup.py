import random
from collections import defaultdict

import numpy as np
import pytest

from pluvia.llm import near_dedup as nd
from pluvia.llm import shingles as sh
from pluvia.llm.components import components
from tests.llm.helpers import frame, odd_rows, rows_of, sentence, shingles


def brute(rows, pct=85):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= pct * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    found = []
    for i, r in enumerate(rows):
        known = [x for x in ids[root(i)] if x is not None]
        least = min(known) if known else None
        found.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(found, key=repr)


def edited(rng, text, share):
    return " ".join(f"e{rng.random()}" if rng.random() < share else w for w in text.split())


def families():
    """Copies of an original that are like it but not like each other, chains, and shared halves."""
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(3):
        base = sentence(rng, 150, 10_000)
        rows.append((1000 + n, base, "a", "s"))
        for _ in range(25):
            n += 1
            rows.append((n, edited(rng, base, 0.012), "a", "s"))
        chain = base
        for _ in range(8):
            n += 1
            chain = edited(rng, chain, 0.008)
            rows.append((n, chain, "a", "s"))
        for _ in range(6):
            n += 1
            half = base.split()[:75] + sentence(rng, 75, 10_000).split()
            rows.append((n, " ".join(half), "a", "s"))
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), families()], ids=["odd", "families"])
def test_like_brute_force(spark, rows):
    got = rows_of(
        nd.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept"
    )
    assert got == brute(rows)


def test_prefix_join_finds_all_links(spark):
    """With a label of its own for each node, the exact join alone finds every link."""
    rows = [r for r in families() if r[1]]
    sets = {i: sh.shingle_sets([t.encode()])[0] for i, t, *_ in rows}
    nodes = [(str(i).encode(), str(i).encode(), len(s), s.tobytes()) for i, s in sets.items()]
    table = spark.createDataFrame(nodes, "node binary, label binary, n long, shingles binary")
    pairs = nd.confirmed(nd.prefix_pairs(table, 85), table, 85)
    got = {frozenset((int(r.a), int(r.b))) for r in pairs.collect()}
    want = set()
    for i in sets:
        for j in sets:
            n = len(np.intersect1d(sets[i], sets[j]))
            if i < j and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                want.add(frozenset((i, j)))
    assert got == want and len(want) > 20


def test_keep_one(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.exceptAll(docs).count() == 0
    want = sorted([r[0] for r in brute(rows) if r[3]], key=repr)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == want


def test_empty_table(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0
    assert nd.keep_one(frame(spark, [(1, None, "a", "s")])).count() == 1


def test_shingle_sets_count_like_tuples():
    texts = [r[1] or "" for r in odd_rows()]
    for got, text in zip(sh.shingle_sets([t.encode() for t in texts]), texts):
        assert len(got) == len(shingles(text))


def test_min_max_estimates_without_bias():
    rng = np.random.default_rng(6)
    agree = []
    for _ in range(40):
        both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        one, two = both[:200], both[100:]
        values = nd.signatures([np.unique(one), np.unique(two)])
        agree.append((values[0] == values[1]).mean())
    assert abs(np.mean(agree) - 1 / 3) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (7, 3)]
    got = components(spark.createDataFrame(edges, "a int, b int")).collect()
    want = {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
