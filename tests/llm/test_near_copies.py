import collections
import math
import re
import string
from types import SimpleNamespace

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import embedding_dedup as V
from strandline.llm import ngram_join as J
from strandline.llm.components import connected_components
from tests.conftest import SF


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def shingles(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """{id: (size, component)} by comparing all pairs; ids are distinct."""
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    of = classes(len(docs), links)
    first = collections.defaultdict(list)
    for (i, _), c in zip(docs, of, strict=True):
        first[c].append(i)
    return {i: (len(s), min(first[c])) for (i, _), s, c in zip(docs, sets, of, strict=True)}


def found(df):
    return {r[0]: (r[1], r[2]) for r in J.near_classes(df).selectExpr("id", "n", "rep.id").collect()}


def family(rng, size, length, edits, shared):
    """Near copies of one text: each with some words replaced, all with a shared passage."""
    base = [f"w{rng.integers(1e9)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = base.copy()
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            words[at] = f"x{rng.integers(1e9)}"
        out.append(" ".join(words + shared))
    return out


def test_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(60)]
    texts = [t for size, length, edits in ((40, 60, 3), (25, 300, 12), (12, 30, 2), (8, 9, 1), (30, 6, 1)) for t in family(rng, size, length, edits, [])]
    texts += [t for _ in range(30) for t in family(rng, 1, 40, 0, shared)] + texts[:5] + ["a b", "A  b", "b a", "", None, "a a a a a a a a", "q " * 999]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert found(df) == want
    kept = {r.doc_id for r in J.drop_near_copies(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_join_on_real_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(odd, empty):
    rows = J.near_classes(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.id, r.rep.id) for r in rows if r.id in (1, 2, 7, 10, 11)} == {(1, 1), (2, 1), (7, 7), (10, 10), (11, 10)}
    kept = J.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id in (3, 4, 9)").count() == 3
    assert J.near_classes(empty).count() == 0 and J.drop_near_copies(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4)), max_size=25), st.integers(1, 6))
def test_shared_tokens_stream(pairs, size):
    pairs.sort()
    frames = [pd.DataFrame(pairs[i : i + size], columns=["token", "ent"]) for i in range(0, len(pairs), size)]
    got = [tuple(r) for f in J._shared(iter(frames)) for r in f.itertuples(index=False)]
    counts = collections.Counter(t for t, _ in set(pairs))
    assert got == sorted(p for p in set(pairs) if counts[p[0]] > 1)


def test_crossing_pairs():
    bits, none = np.ones(J.LONGS, dtype=np.int64), np.zeros(J.LONGS, dtype=np.int64)
    apart = np.full(J.LONGS, -1, dtype=np.int64)
    columns = ["token", "i", "j", "own", "c", "key", "n", "room", "f2", "f3", "sketch"]
    rows = [(1, 0, 0, 0, 1, 10, 8, 8, bits, bits, none), (1, 0, 0, 0, 1, 12, 8, 8, bits, bits, none), (1, 0, 0, 0, 2, 14, 8, 8, bits, bits, none)]
    rows += [(1, 0, 0, 0, 3, 16, 80, 80, bits, bits, none), (1, 0, 0, 0, 4, 18, 8, 8, none, bits, none), (1, 0, 0, 0, 5, 20, 8, 8, bits, none, none)]
    rows += [(1, 0, 0, 0, 6, 22, 8, 8, bits, bits, apart), (1, 0, 1, 0, 1, 10, 8, 8, bits, bits, none), (1, 0, 1, 0, 2, 14, 8, 8, bits, bits, none)]
    rows += [(1, 0, 1, 1, 7, 24, 8, 8, bits, bits, none), (2, 0, 0, 0, 1, 10, 8, 8, bits, bits, none), (2, 0, 0, 0, 2, 14, 8, 6, bits, bits, none)]
    for size in (1, 2, 5, 12):
        frames = [pd.DataFrame(rows[i : i + size], columns=columns) for i in range(0, len(rows), size)]
        got = {tuple(r) for f in J._crossing(iter(frames)) for r in f.itertuples(index=False)}
        assert got == {(10, 14), (12, 14), (10, 24), (14, 24)}


def test_sketches_differ_by_no_more_than_sets():
    rng = np.random.default_rng(8)
    for size in (1, 40, 3000):
        a, b = (np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate((a[size // 3 :], b)))
        apart = np.bitwise_count((J.sketch_of(a) ^ J.sketch_of(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_common_passage_writes_few_pairs(spark, monkeypatch):
    """2,000 short texts share one passage that is most of each; 400 near copies of one text lie close to the threshold."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(44))
    texts = [f"{passage} " + " ".join(f"q{rng.integers(1e9)}" for _ in range(6 + i % 9)) for i in range(2000)]
    texts += family(rng, 400, 120, 4, [])
    counted, verify = [], J.verify

    def counting(pairs, sets):
        counted.append(pairs.count())
        return verify(pairs, sets)

    monkeypatch.setattr(J, "verify", counting)
    docs = list(enumerate(texts))
    got = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(counted) <= 3 * len(texts)
    sample = [docs[i] for i in range(0, 2400, 6)]
    assert found(spark.createDataFrame(sample, "doc_id long, text string")) == brute(sample)
    assert {i: got[i] for i in range(2000, 2400)} == {i: x for i, x in brute(docs[2000:]).items()}


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (12, 9), (2, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = spark.range(200).selectExpr("(id * 7919) % 201 a", "((id + 1) * 7919) % 201 b")
    assert {r.c for r in connected_components(path).collect()} == {0}


def vectors(rng, families, lone, d=16):
    out = [x for size in families for c in [rng.normal(size=d)] for x in c + rng.normal(size=(size, d)) * 0.08]
    return np.array([*out, *rng.normal(size=(lone, d))])


def test_graph_finds_links():
    x = vectors(np.random.default_rng(1), [300, 40, 2, 2, 2, 9], 3000)
    g = V.Graph(x)
    beam, recall = g.audited_beam(0.95)
    q, n = g.links_of(V.unit(x), 0.95, beam)
    truth = V.unit(x) @ V.unit(x).T >= 0.95
    got = np.zeros_like(truth)
    got[q, g.order[n]] = True
    assert recall >= V.RECALL and not (got & ~truth).any() and (got & truth).sum() >= 0.98 * truth.sum()


class Losing(V.Graph):
    """Loses the links of vectors in groups of at most ``lost`` at beams under ``enough``, but not a vector's hit on itself."""

    lost, enough = 2, 4 * V.BEAM

    def links_of(self, exact, threshold, beam):
        near = exact @ self.exact.T
        q, n = np.nonzero(near >= threshold)
        few = (np.bincount(q, minlength=len(exact)) <= self.lost)[q] & (beam < self.enough) & (near[q, n] < 1 - 1e-9)
        return q[~few], n[~few]


def test_audit_sees_lost_pairs_beside_a_large_group():
    x = vectors(np.random.default_rng(5), [600, *[2] * 100], 400, d=32)
    g = Losing(x)
    beam, recall = g.audited_beam(0.95)
    assert (beam >= Losing.enough) and recall >= V.RECALL


def test_audit_of_other_shards_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 32))
    shard = V._Shard(0.95, V.BEAM)
    shard.add(np.arange(500), np.ones(500, dtype=np.int64), x)
    shard.close(True)
    shard.graph.__class__ = Losing
    out = shard.answer(np.arange(1000, 1040), x[:40] + rng.normal(size=(40, 32)) * 0.08)
    assert out is not None and out.num_rows == 40 and shard.asked_beam >= Losing.enough


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = vectors(rng, [60, 5, 3, 2, 2], 200)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(1000 + i, data[3][1]) for i in range(3)] + [(2000, [0.0] * 16), (2001, [float("nan")] * 16), (2002, None), (2003, []), (2004, [1.0, None]), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [float("inf"), 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'x' node", "1 w")
    ok = [(i, np.array(v)) for i, v in data if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a, (_, v) in enumerate(ok) for b, (_, u) in enumerate(ok) if a != b and len(v) == len(u) and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.95 - 1e-12]
    count, of = collections.Counter(a for a, _ in links), classes(len(ok), links)
    first = {c: min(ok[k][0] for k in range(len(ok)) if of[k] == c) for c in set(of)}
    want = {i: (0, i) for i, _ in data} | {ok[k][0]: (count[k], first[of[k]]) for k in range(len(ok))}
    for shards in (1, 5):
        assert {r[0]: (r[1], r[2]) for r in V.near_vectors(df, shards=shards).collect()} == want
    assert {r[0]: (r[1], r[2]) for r in V.near_vectors(df, shards=2, query_rows=100).collect()} == want
    assert V.near_vectors(df.where("false")).count() == 0
    monkeypatch.setattr(V, "SHARD_BYTES", 12 * 16 * 50)  # shards of 50 vectors
    small = V.near_vectors(df).collect()
    assert {r[0]: (r[1], r[2]) for r in small} == want and all(r.audited_recall >= V.RECALL for r in small)
    twice = V.near_vectors(df.where("vec_id in (2000, 2005)").union(df.where("vec_id = 2005"))).orderBy("id").collect()
    assert [tuple(r)[:3] for r in twice] == [(2000, 0, 2000), (2005, 1, 2005), (2005, 1, 2005)]


def test_query_finds_links(spark, tmp_path):
    """The registered query over a table that has links, unlike the small test tables."""
    from strandline.llm.queries import QUERIES

    x = vectors(np.random.default_rng(21), [30, 4, 2], 80)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = V.unit(x)
    near = unit @ unit.T >= 0.95
    of = classes(len(x), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    first = {c: min(i for i in range(len(x)) if of[i] == c) for c in set(of)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op2_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: (int(near[i].sum()) - 1, first[of[i]], first[of[i]] == i) for i in range(len(x))} and sum(n for n, *_ in got.values()) > 500


def test_lengths_beyond_squares(spark):
    """Components whose squares overflow or vanish have a cosine all the same; scaling changes no digit of others."""
    data = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [5e-324, 1e-323]), (5, [1e300, -1e300]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in V.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}
    x = np.random.default_rng(1).normal(size=(50, 7))
    assert (V.unit(x) == x / np.linalg.norm(x, axis=1, keepdims=True)).all()


def test_layer_above_larger_than_what_is_built(monkeypatch):
    """In shards of more than 49,152 vectors the layer above held nodes that the layer below did not have yet; here it is half as large."""
    monkeypatch.setattr(V, "math", SimpleNamespace(log=lambda x: math.log(2)))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 16))
    x[4000:4400] = x[:400] + rng.normal(size=(400, 16)) * 0.02
    graph = V.Graph(x)
    assert graph.sizes[1] > 3072
    beam, recall = graph.audited_beam(0.95)
    q, n = graph.links_of(V.unit(x), 0.95, beam)
    got = set(zip(q.tolist(), graph.order[n].tolist(), strict=True))
    u = V.unit(x)
    truth = set(zip(*(i.tolist() for i in np.nonzero(u @ u.T >= 0.95)), strict=True))
    assert recall >= 0.99 and got <= truth and len(got) >= 0.99 * len(truth)
