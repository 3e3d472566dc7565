import pytest

from pluvia.llm import line_dedup as ld
from tests.llm.helpers import frame, odd_rows, sentence, words
import random


def brute(rows, least):
    """Texts without the lines that the definition names; by (id, text)."""
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}, key=lambda r: r[:2])
    docs = [
        [(k, x) for k, x in enumerate(text.split("\n")) if words(x)] for _, _, text in order
    ]
    first, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for s in range(len(lines)):
            e, n = s, 0
            while e < len(lines) and n < least:
                n += len(words(lines[e][1]))
                e += 1
            if n < least:
                continue
            key = tuple(x for _, x in lines[s:e])
            if key not in first:
                first[key] = d, s
                continue
            fd, fs = first[key]
            other, a, b, m = docs[fd], 0, 0, e - s
            while min(s, fs) - a > 0 and lines[s - a - 1][1] == other[fs - a - 1][1]:
                a += 1
            while (
                e + b < len(lines) and fs + m + b < len(other)
                and lines[e + b][1] == other[fs + m + b][1]
            ):
                b += 1
            gone[d].update(k for k, _ in lines[s - a : e + b])
    return {
        (None if none else i, text): "\n".join(
            x for k, x in enumerate(text.split("\n")) if k not in gone[d]
        )
        for d, (none, i, text) in enumerate(order)
    }


def distinct_ids(rows):
    """Rows of one id are ordered by a hash; the brute force needs one text an id."""
    seen, kept = {}, []
    for r in rows:
        if seen.setdefault(r[0], r[1]) == r[1]:
            kept.append(r)
    return kept


def passages():
    rng = random.Random(8)
    shared = [sentence(rng, n) for n in (60, 20, 20, 20, 5, 45, 8)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(len(shared))
            lines += rng.choice([shared[a : a + 3], [sentence(rng, 12)], ["", " "], [shared[4]] * 12])
        rows.append((i, "\n".join(lines), "aa", "s"))
    return rows


@pytest.mark.parametrize("rows", [distinct_ids(odd_rows()), passages()], ids=["odd", "passages"])
@pytest.mark.parametrize("least", [50, 20])
def test_like_brute_force(spark, rows, least):
    docs = frame(spark, rows)
    got = ld.drop_repeated_runs(docs, min_words=least, removed="n_removed").collect()
    want = brute(rows, least)
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        before = texts[r.doc_id]
        assert r.text == (None if before is None else want[r.doc_id, before])
        left = 0 if r.text in (None, "") and before not in (None, "") else 1
        assert before is None or r.n_removed == before.count("\n") + 1 - (
            r.text.count("\n") + 1 if left else 0
        )


def test_columns_pass(spark):
    docs = frame(spark, odd_rows())
    got = ld.drop_repeated_runs(docs)
    assert got.columns == docs.columns
    assert got.drop("text").exceptAll(docs.drop("text")).count() == 0
    assert ld.drop_repeated_runs(frame(spark, [])).count() == 0


def test_short_lines_stay_and_long_passages_go(spark):
    rng = random.Random(1)
    passage, boiler = sentence(rng, 60), "Licensed under these terms."
    rows = [(i, "\n".join([sentence(rng, 30), passage, boiler]), "a", "s") for i in range(5)]
    got = {r.doc_id: r.text for r in ld.drop_repeated_runs(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 5):
        # The boilerplate follows the passage in the first place too, so it is part of the run.
        assert got[i] == rows[i][1].split("\n")[0]


def test_windows_share_fingerprints():
    import numpy as np

    rng = np.random.default_rng(2)
    words_, hashes = rng.integers(1, 30, 200).astype("i4"), rng.integers(0, 9, 200).astype("u8")
    ends = ld.window_ends(words_, 50)
    marks = ld.fingerprints(hashes, ends)
    for s, (e, m) in enumerate(zip(ends, marks)):
        assert words_[s:e].sum() >= 50 > words_[s : e - 1].sum()
        low = hashes[s:e].min()
        assert m == max(i for i in range(s, e) if hashes[i] == low)


def brute_every(rows, least):
    """Texts without the runs that any earlier place has: every place against all before; by id."""
    docs = [
        [(k, x) for k, x in enumerate(text.split("\n")) if words(x)]
        for text in (r[1] for r in sorted(rows))
    ]
    places = [(d, s) for d, lines in enumerate(docs) for s in range(len(lines))]
    gone = [set() for _ in docs]
    for p, (d, s) in enumerate(places):
        for e, f in places[:p]:
            n = size = 0
            while (
                s + n < len(docs[d]) and f + n < len(docs[e])
                and docs[d][s + n][1] == docs[e][f + n][1]
            ):
                size += len(words(docs[d][s + n][1]))
                n += 1
            if size >= least:
                gone[d].update(k for k, _ in docs[d][s : s + n])
    return {
        r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[d])
        for d, r in enumerate(sorted(rows))
    }


def tails():
    """Passages with tails of several lines, of which the first place has none or others."""
    rng = random.Random(21)
    heads = [[sentence(rng, 60)], [sentence(rng, 3), sentence(rng, 50)], [sentence(rng, 12)] * 5]
    short = [sentence(rng, n) for n in (1, 4, 9, 20, 30)]
    rows = []
    for i in range(70):
        lines = [sentence(rng, 5)]
        for _ in range(rng.randint(1, 3)):
            lines += rng.choices(short, k=rng.randint(0, 2)) + rng.choice(heads)
            lines += rng.choices(short, k=rng.randint(0, 4))
        rows.append((i, "\n".join(lines), "aa", "s"))
    return rows


@pytest.mark.parametrize("least", [50, 20])
def test_runs_of_every_earlier_place_go(spark, least):
    for rows in (tails(), passages()):
        docs = frame(spark, rows)
        got = ld.drop_repeated_runs(docs, min_words=least).collect()
        assert {r.doc_id: r.text for r in got} == brute_every(rows, least)


def test_tail_that_the_first_place_lacks_goes(spark):
    rng = random.Random(3)
    head, tail = sentence(rng, 60), sentence(rng, 20)
    other = [sentence(rng, 30) for _ in range(3)]
    rows = [
        (0, "\n".join([head, other[0]]), "a", "s"),
        (1, "\n".join([head, tail, other[1]]), "a", "s"),
        (2, "\n".join([head, tail, other[2]]), "a", "s"),
    ]
    got = {r.doc_id: r.text for r in ld.drop_repeated_runs(frame(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: f"{tail}\n{other[1]}", 2: other[2]}
