import hashlib
from collections import defaultdict

import pytest

from pluvia.llm.exact_dedup import exact_duplicates
from tests.llm.helpers import ascii_lower, frame, odd_rows, rows_of

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows, best):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[ascii_lower(text or "")].append(i)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(found, key=repr)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_groups_of_odd_rows(spark, keep, best):
    rows = odd_rows()
    assert rows_of(exact_duplicates(frame(spark, rows), keep=keep), *COLUMNS) == brute(rows, best)


def test_other_case_is_kept_apart(spark):
    rows = [(1, "Été", "a", "s"), (2, "été", "a", "s"), (3, "ABC", "a", "s"), (4, "abc", "a", "s")]
    found = {r[0]: r[1] for r in rows_of(exact_duplicates(frame(spark, rows)), *COLUMNS)}
    assert found == {1: 1, 2: 2, 3: 3, 4: 3}


def test_empty_table(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_unknown_choice(spark):
    with pytest.raises(ValueError):
        exact_duplicates(frame(spark, []), keep="first")


def test_no_python_in_the_plan(spark):
    plan = exact_duplicates(frame(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
