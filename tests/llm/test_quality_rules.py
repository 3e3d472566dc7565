from pyspark.sql import functions as F

from pluvia.llm import quality_rules as q
from tests.llm.helpers import SCHEMA, frame, odd_rows, rows_of, words

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(row):
    text = row[1] or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    at: dict = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (
        row[0], len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_base_counts(spark):
    rows = odd_rows() + [
        (100, "a b c d e f g h " * 3 + "x " * 9 + "y", "aa", "s"),
        (101, "# * $ % & | < > #x " + "wordé " * 30, "aa", "s"),
        (102, "one two three four five six seven eight nine " * 2, "aa", "s"),
    ]
    got = rows_of(q.cascade(frame(spark, rows)), *BASE)
    assert got == sorted(map(brute, rows), key=repr)


def test_verdicts(spark):
    clean = " ".join(f"Word{i} and" for i in range(40))
    rows = [
        (1, clean, "a", "s"),
        (2, " | ".join(clean.split()), "a", "s"),
        (3, "!! ".join(clean.upper().split()), "a", "s"),
        (4, " ".join(f"{i}{i}" for i in range(50)), "a", "s"),
        (5, "tiny text", "a", "s"),
        (6, " ".join(x * 30 for x in clean.split()), "a", "s"),
    ]
    kept = {r[0]: r[1] for r in rows_of(q.cascade(frame(spark, rows)), "doc_id", "kept")}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_order_does_not_change_verdicts(spark):
    docs, rules = frame(spark, odd_rows()), q.default_rules()
    one = rows_of(q.cascade(docs, rules=rules), "doc_id", "kept")
    assert one == rows_of(q.cascade(docs, rules=rules[::-1]), "doc_id", "kept")


def test_ranking_by_rejections_per_cost(spark):
    sample = spark.range(2000).select(F.lit("x").alias("text_"), "id")
    rules = [q.Rule("never", F.col("id") < 0), q.Rule("often", F.col("id") % 2 == 0)]
    assert [r.name for r, _, _ in q.ranked(sample, rules)] == ["often", "never"]
    assert [round(share, 1) for _, share, _ in q.ranked(sample, rules)] == [0.5, 0.0]
    assert q.ranked(sample, []) == []


def test_keeps_rows_whole(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    good = [i for i, k in rows_of(q.cascade(docs), "doc_id", "kept") if k]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(good, key=repr)
    assert kept.exceptAll(docs).count() == 0


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert q.cascade(empty).count() == 0
    assert q.keep_good(empty).count() == 0
    rows = [(1, "word " * 25, "a", "s")]
    assert rows_of(q.cascade(frame(spark, rows), rules=[]), "kept") == [(False,)]


def test_no_python_in_the_plan(spark):
    plan = q.cascade(frame(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
