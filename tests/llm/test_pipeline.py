"""The stages of the corpus pipeline."""

import random
import re
from collections import Counter

import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pluvia.llm.shared import stored
from tests.llm.helpers import frame, sentence, shingles, words
from tests.llm.test_line_dedup import brute_every as every_earlier_place
from tests.llm.test_mixing import in_order, targets
from tests.llm.test_near_dedup import brute as near_classes
from tests.llm.test_quality_rules import brute as quality


def alike(one, two):
    a, b = shingles(one), shingles(two)
    return len(a & b) / len(a | b)


def test_near_links_from_080_on(spark):
    rng = random.Random(12)
    rows = []
    for i in range(0, 40, 2):
        base = sentence(rng, 204, 10_000).split()
        # 200 shingles; a changed word inside replaces five: c = 4 gives 180 / 220, c = 5 175 / 225.
        near = list(base)
        for k in range(4 if i < 30 else 5):
            near[20 + 30 * k] = "changed"
        rows += [(i, " ".join(base), "aa", "s"), (i + 1, " ".join(near), "aa", "s")]
    likeness = {i: alike(rows[i][1], rows[i + 1][1]) for i in range(0, 40, 2)}
    assert all((0.80 <= x < 0.85) == (i < 30) for i, x in likeness.items())
    kept = {r.doc_id for r in cp.near(spark, frame(spark, rows), "").collect()}
    assert kept == {r[0] for r in rows if r[0] % 2 == 0 or r[0] > 30}


def rejected(row):
    """The quality rules, one by one."""
    text = row[1] or ""
    _, n, chars, symbols, repeated_lines, _, failed = quality(row)
    letters, capitals = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    return (
        failed or 10 * symbols > 2 * n or not 2 * n <= chars <= 20 * n or 2 * capitals > letters
        or 2 * letters < chars or 2 * len(re.findall("[!?]", text)) > n
        or 100 * repeated_lines > 50 * (text.count("\n") + 1)
    )


def corpus():
    """Documents of every kind: rejected, with passages that others have, near and exact copies."""
    rng = random.Random(23)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}word{rng.randrange(9999)}x" for _ in range(n))
    passage = "\n".join(line(20) for _ in range(4))
    rows = [(1, None), (2, ""), (3, "short"), (4, "# | " * 40), (5, line(300).upper())]
    for i in range(10, 50):
        parts = [line(30) for _ in range(6)]
        if i % 4 == 0:
            parts.insert(3, passage)
        rows.append((i, "\n".join(parts)))
    for i in range(60, 70):  # near copies without a line break, so that no line is repeated
        base = line(200).split(" ")
        rows.append((i, " ".join(base)))
        base[7] = "changed"
        rows.append((i + 30, " ".join(base)))
    rows += [(80, rows[9][1]), (82, rows[12][1]), (81, line(200))]
    return [(i, t, "aa", None if (i or 0) % 9 == 0 else f"s{(i or 0) % 3}") for i, t in rows]


def test_every_stage_on_what_the_stage_before_kept(spark, tmp_path, monkeypatch):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def kept(df, name):
        seen[name.removeprefix("pipeline-")] = out = stored(df, name)
        return out

    monkeypatch.setattr(cp, "stored", kept)
    result = cp.run(spark, str(tmp_path))
    assert list(seen) == [name for name, _ in cp.STAGES]
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    for name in list(seen)[:-1]:
        assert seen[name].columns == columns
        lengths = seen[name].select("text", "n_chars").collect()
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lengths)
    rows = {n: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
            for n, df in list(seen.items())[:-1]}

    good = [r for r in corpus() if not rejected(r)]
    assert sorted(rows["quality_rules"], key=repr) == sorted(good, key=repr) and len(good) < len(corpus())

    want = every_earlier_place(good, 50)
    assert sorted(rows["line_dedup"], key=repr) == sorted(
        [(r[0], want[r[0]], *r[2:]) for r in good], key=repr
    )
    assert sum(want[r[0]] != r[1] for r in good) >= 9

    classes = near_classes(rows["line_dedup"], 80)
    assert set(rows["near_dedup"]) <= set(rows["line_dedup"])
    assert sorted(r[0] for r in rows["near_dedup"]) == sorted(i for i, *_, first in classes if first)
    assert len(rows["near_dedup"]) < len(good)

    size = lambda rs: sum(len(words(r[1])) for r in rs)
    own = {s: [r for r in rows["near_dedup"] if r[3] == s] for s in {r[3] for r in rows["near_dedup"]}}
    aims = targets({s: size(rs) for s, rs in own.items()})
    for s, rs in own.items():
        mixed = [r for r in rows["source_mix"] if r[3] == s]
        assert abs(size(mixed) - aims[s]) <= 0.02 * aims[s] + 2
        for r in rs:
            taken = [words(m[1]) for m in mixed if m[0] == r[0]]
            assert sum(map(len, taken)) <= 3 * len(words(r[1]))
            assert all(in_order(t, words(r[1])) for t in taken)

    library = Tokenizer.from_file(public_tokenizers.path(cp.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    texts = Counter(r[1] for r in rows["source_mix"])
    coded = {t: library.encode(t, add_special_tokens=False).ids for t in texts}
    got = Counter((r.n_tokens, tuple(r.ids), r.decoded) for r in result.collect())
    assert got == Counter(
        {k: n for k, n in Counter(
            (len(coded[t]), tuple(coded[t]), library.decode(coded[t], skip_special_tokens=False))
            for t in texts.elements()
        ).items()}
    )


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
