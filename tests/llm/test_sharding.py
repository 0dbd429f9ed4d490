import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import sharding as S
from strandline.llm.queries import QUERIES
from tests.conftest import SF


def smallest_capacity(sizes, k):
    """Brute force: the smallest capacity of k contiguous shards, by trying all sums of runs."""
    best = None
    for c in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        used, shards = 0, 1
        for s in sizes:
            if s > c:
                break
            if used + s > c:
                shards, used = shards + 1, 0
            used += s
        else:
            if shards <= k:
                best = c
                break
    return best


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(16, 60), min_size=1, max_size=18), st.integers(1, 6))
def test_capacity_is_the_minimax(spark, sizes, k):
    groups = spark.createDataFrame([(s,) for s in sizes], "gsize long")
    r = S.minimax_cuts(groups, k).first()
    assert r.capacity == smallest_capacity(sorted(sizes), k)
    at = [sum(1 for x in sizes if x < c["size"]) + c["nth"] for c in r.cuts]
    parts = [sum(sorted(sizes)[a:b]) for a, b in zip([0, *at], [*at, len(sizes)], strict=True)]
    assert len(parts) <= k and max(parts) == r.capacity


def check(rows, k):
    shards, of = defaultdict(list), defaultdict(set)
    for r in rows:
        shards[r.shard].append(r.slot)
        of[bytes(r.digest)].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and all(0 <= s < k for s in shards)
    assert all(len(v) == 1 for v in of.values())


@pytest.mark.parametrize("k", [1, 3, 40])
def test_odd_rows(odd, k):
    rows = S.shard(odd, k).collect()
    check(rows, k)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.id is not None:
            b = (texts[r.id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(b) + 16, zlib.crc32(b))


def test_empty(empty):
    assert S.shard(empty).count() == 0


def test_real_tables_are_balanced(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = S.shard(docs, 5).collect()
    check(rows, 5)
    size = defaultdict(int)
    group = defaultdict(int)
    for r in rows:
        size[r.shard] += r["size"]
        group[bytes(r.digest)] += r["size"]
    assert max(size.values()) == smallest_capacity_fast(sorted(group.values()), 5)
    assert QUERIES["op7_shard_minimax"](spark, SF).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def smallest_capacity_fast(sizes, k):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        c, used, n = (lo + hi) // 2, 0, 1
        for s in sizes:
            if used + s > c:
                n, used = n + 1, 0
            used += s
        lo, hi = (lo, c) if n <= k else (c + 1, hi)
    return lo
