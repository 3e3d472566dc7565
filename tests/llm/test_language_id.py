import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pluvia.llm import language_id as li
from tests.llm.helpers import frame, odd_rows, rows_of

SOUNDS = {
    "one": "the ing and tion er ou".split(),
    "two": "der ung sch ein ü zu".split(),
    "tre": "que é aux le ment oi".split(),
}


def sample_text(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, sample_text(rng, lang, rng.choice([3, 20, 200])), lang, "s"))
    return rows


class Tree:
    """One language by the book: counts of all contexts, a byte at a time."""

    def __init__(self, texts, order):
        self.order = order
        self.after = defaultdict(lambda: defaultdict(int))
        for t in texts:
            data = li.PAD + t.lower().encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.after[data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data, total = li.PAD + text.lower().encode(), 0.0
        for i in range(self.order, len(data)):
            for k in range(self.order, -1, -1):
                seen = self.after.get(data[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
        return total


def test_code_lengths_by_the_book(spark):
    rows = corpus(60)
    docs = frame(spark, rows).select(F.col("doc_id").alias("key"), "lang", "text")
    trees = li.fit(docs)
    own = {x: Tree([t for _, t, lang, _ in rows if lang == x], li.ORDER) for x in trees.languages}
    texts = ["the und que", "", "Zu ß日本", "x" * 50, *[t for _, t, *_ in corpus(80)[60:]]]
    got = trees.code_lengths([t.lower().encode() for t in texts])
    want = np.array([[own[x].bits(t) for x in trees.languages] for t in texts])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_steps_do_not_matter(spark, monkeypatch):
    docs = frame(spark, corpus(60)).select(F.col("doc_id").alias("key"), "lang", "text")
    trees = li.fit(docs)
    texts = [t.encode() for _, t, *_ in corpus(50)] + [b"", b"a"]
    whole = trees.code_lengths(texts)
    monkeypatch.setattr(li, "STEP", 97)
    assert np.allclose(trees.code_lengths(texts), whole, atol=1e-3)


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in li.learn_and_identify(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    right = sum(got[i].lang_pred == lang for i, _, lang, _ in held)
    assert right >= 0.97 * len(held) and len(held) > 60
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_source_and_id_are_no_inputs(spark):
    rows = corpus()
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    changed = [(i, t, "zzz" if i in held else lang, f"x{i}") for i, t, lang, _ in rows]
    columns = ("doc_id", "lang_pred", "score")
    one = rows_of(li.learn_and_identify(frame(spark, rows)), *columns)
    assert one == rows_of(li.learn_and_identify(frame(spark, changed)), *columns)


def test_odd_rows(spark):
    rows = odd_rows() + [(200, "123 ... !", "aa", "s"), (201, None, None, None)]
    got = li.learn_and_identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    for r in got:
        letters = [t for t in texts[r.doc_id] if t and any(c.isalpha() for c in t)]
        assert r.lang_pred in ({"aa", "bb"} if letters else {"und"}) | (
            {"und"} if len(letters) < len(texts[r.doc_id]) else set()
        )
        assert r.held_out == (zlib.crc32(str(r.doc_id or "").encode()) % 3 == 1) or r.doc_id is None


def test_nothing_to_learn_from(spark):
    assert li.learn_and_identify(frame(spark, [])).count() == 0
    rows = [(1, "some text", None, "s"), (2, None, "aa", "s")]
    got = rows_of(li.learn_and_identify(frame(spark, rows)), "lang_pred", "score")
    assert got == [("und", 0.0)] * 2


def test_key_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    table = li.KeyTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 40, 5000, dtype=np.uint64), keys)
    assert (table.find(others) == -1).all()
    assert (li.KeyTable(keys[:0]).find(others) == -1).all()
