import hashlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import exact_dedup as E


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("fraction", [1 / 1024, 0.2])
def test_groups_match_brute_force(spark, odd, fraction):
    got = sorted(map(tuple, E.exact_groups(odd, heavy_fraction=fraction).collect()), key=str)
    groups: dict = {}
    for r in odd.collect():
        groups.setdefault(fold(r.text), []).append(r.doc_id)
    for i, keep, size, kept, digest in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(digest))
        ids = [x for x in groups[text] if x is not None]
        assert (keep, size) == (max(ids, default=None), len(groups[text])) and (not kept or i == keep)
    assert len(got) == odd.count() and sum(r[3] for r in got) == len(groups)


def test_heavy_and_tail_agree(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'HOT' when id % 3 = 1 then concat('t', id % 50) else concat('u', id) end as text")
    plain = sorted(map(tuple, E.exact_groups(docs, heavy_fraction=1.0).select("id", "keep_id", "group_size", "kept").collect()))
    split = sorted(map(tuple, E.exact_groups(docs, heavy_fraction=0.01).select("id", "keep_id", "group_size", "kept").collect()))
    assert plain == split and max(r[2] for r in split) == 1000
    kept = E.drop_exact_copies(docs, heavy_fraction=0.01)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in split if r[3]]


def test_drop_keeps_columns_and_one_of_repeated_rows(odd, empty):
    kept = E.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1
    assert E.drop_exact_copies(empty).count() == 0 and E.exact_groups(empty).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=30), max_size=6), st.integers(1, 5))
def test_misra_gries_error_is_bounded(batches, k):
    counters: dict = {}
    for b in batches:
        counters = E.misra_gries(counters, pd.Series(b, dtype="int64").value_counts(), k)
    all_rows = [x for b in batches for x in b]
    assert len(counters) <= k
    for x in set(all_rows):
        true = all_rows.count(x)
        assert true - len(all_rows) / (k + 1) <= counters.get(x, 0) <= true
