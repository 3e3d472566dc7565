import hashlib
import random

import numpy as np
import pytest

from pluvia.llm import substring_dedup as sd
from tests.llm.helpers import frame, odd_rows, rows_of, sentence, words

COLUMNS = ("doc_id", "n_words", "n_removed", "text")


def brute(rows, n=sd.WINDOW):
    least = {}
    for i, text, *_ in rows:
        w = words(text)
        for a in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[a : a + n])
            least[key] = min(i, least.get(key, i))
    found = []
    for i, text, *_ in rows:
        w = words(text)
        keep = [True] * len(w)
        for a in range(len(w) - n + 1) if i is not None else ():
            if least[tuple(w[a : a + n])] < i:
                keep[a : a + n] = [False] * n
        rest = [x for x, k in zip(w, keep) if k]
        found.append((i, len(w), len(w) - len(rest), " ".join(rest)))
    return sorted(found, key=repr)


def check(spark, rows, n=sd.WINDOW):
    assert rows_of(sd.drop_repeated(frame(spark, rows), n), *COLUMNS) == brute(rows, n)


def test_odd_rows(spark):
    check(spark, odd_rows())


def test_empty_table(spark):
    assert sd.drop_repeated(frame(spark, [])).count() == 0


def test_window_too_short(spark):
    with pytest.raises(ValueError):
        sd.drop_repeated(frame(spark, odd_rows()), n=4)


def passages(seed):
    """Passages in many contexts, cut at both ends, changed inside, repeated within a document."""
    rng = random.Random(seed)
    shared = [sentence(rng, rng.randint(10, 70), 5000) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(shared).split()
            a, b = sorted(rng.choices(range(len(part) + 1), k=2)) if rng.random() < 0.5 else (0, 99)
            part = part[a:b]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = rng.choice(["other", "Other", "w1"])
            parts += [sentence(rng, rng.randint(0, 20), 5000), " ".join(part)]
        rows.append((rng.choice([i, i, 1000 - i]), rng.choice([" ", "\n", "\t\x0b "]).join(parts), "aa", "s"))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_passages(spark, seed):
    check(spark, passages(seed))


def test_few_words_and_other_windows(spark):
    """Two words make all texts: nearly every window is repeated, and marks lie everywhere."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(0, 60), 2), "aa", "s") for i in range(60)]
    check(spark, rows, n=6)
    check(spark, rows, n=9)


def test_mark_in_many_places_of_one_document(spark):
    """The first document has a mark in several shards, each with other words around."""
    rng = random.Random(9)
    core = sentence(rng, sd.MARK, 10**6)
    around = [(sentence(rng, 8, 10**6), sentence(rng, 8, 10**6)) for _ in range(5)]
    long = " ".join(f"{a} {core} {b} {sentence(rng, 1500, 10**6)}" for a, b in around)
    rows = [(1, long, "aa", "s")]
    rows += [(2 + k, f"x{k} {a} {core} {b} y{k}", "aa", "s") for k, (a, b) in enumerate(around)]
    check(spark, rows)
    assert all(r[2] == 21 for r in brute(rows) if r[0] > 1)


def test_window_that_the_first_document_with_its_mark_lacks(spark):
    rng = random.Random(11)
    text = sentence(rng, 40, 10**6).split()
    first = [*text[:20], "changed", *text[21:]]
    rows = [(1, " ".join(first), "aa", "s"), (2, " ".join(text), "aa", "s"),
            (3, "z " + " ".join(text), "aa", "s")]
    check(spark, rows)
    assert [r[2] for r in brute(rows)] == [0, 39, 40]


def test_texts_that_share_an_id(spark):
    rng = random.Random(13)
    a, b = sentence(rng, 60, 10**6), sentence(rng, 60, 10**6)
    rows = [(5, a, "aa", "s"), (5, b, "aa", "s"), (5, a + " " + b, "aa", "s"), (6, b + " end", "aa", "s"),
            (7, a, "aa", "s"), (7, a, "aa", "s"), (7, b.replace(" ", "\n"), "aa", "s")]
    check(spark, rows)


def test_automaton_has_the_longest_matches():
    rng = random.Random(17)
    for _ in range(60):
        runs = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.choice("abcd") for _ in range(30)]
        inside = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [
            max((m for m in range(i + 2) if not m or tuple(text[i + 1 - m : i + 1]) in inside))
            for i in range(len(text))
        ]
        assert sd.Automaton(runs).statistics(text) == want


def test_words_hashed_in_steps(monkeypatch):
    rng = random.Random(19)
    text = sentence(rng, 3000).encode()
    whole = sd.hashed_texts([text])[0].tolist()
    assert len(set(whole)) == len(set(text.split()))
    monkeypatch.setattr(sd, "STEP", 100)
    assert sd.hashed_texts([text])[0].tolist() == whole and len(whole) == 3000
    parts = [text[:1500], b"", text[1500:]]
    words, ends = sd.hashed_texts(parts)
    assert ends.tolist() == [len(parts[0].split()), len(parts[0].split()), len(words)]
    assert sd.hashed_texts([b""])[0].tolist() == [] == sd.hashed_texts([b" ", b""])[0].tolist()


def test_marks_belong_to_windows():
    """Every window has a mark that depends on its own words only."""
    rng = np.random.default_rng(21)
    words = rng.integers(0, 30, 800).astype(np.uint64)
    ends = np.array([0, 100, 105, 105, 400, 800])
    found, places = sd.marks(words, ends, 13)
    least = {}
    grams = {p: h for h, p in zip(found.tolist(), places.tolist())}
    for a, b in zip([0, *ends], ends):
        for i in range(a, b - 12):
            inside = [grams[p] for p in range(i, i + 9) if p in grams]
            least.setdefault(tuple(words[i : i + 13].tolist()), set()).add(min(inside))
    assert all(len(x) == 1 for x in least.values()) and len(places) < 400


def test_query_digest(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    from pluvia.llm.queries import substring_digests

    found = rows_of(substring_digests(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows)]
    assert found == sorted(want, key=repr)
