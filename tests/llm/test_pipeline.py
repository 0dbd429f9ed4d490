import collections
import re

from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import queries, toxicity
from strandline.llm.common import materialize
from tests.conftest import SF
from tests.llm.test_near_copies import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as row", "'x' as digest")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() > 0
        out[name] = (before.collect(), docs.collect())
    ids = {n: ([r.doc_id for r in a], [r.doc_id for r in b]) for n, (a, b) in out.items()}
    model = queries.toxicity_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    a, b = out["toxicity"]
    assert sorted(ids["toxicity"][1]) == sorted(r.doc_id for r in a if model.score(r.text) < toxicity.THRESHOLD)
    a, b = out["exact_dedup"]
    last = {}
    for r in a:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        last[key] = max(r.doc_id, last.get(key, -1))
    assert sorted(ids["exact_dedup"][1]) == sorted(last.values())
    a, b = out["ngram_jaccard_join"]
    assert sorted(ids["ngram_jaccard_join"][1]) == sorted(i for i, (_, c) in brute([(r.doc_id, r.text) for r in a]).items() if i == c)
    a, b = out["mix_to_target_weights"]
    times = collections.Counter(ids["mix_to_target_weights"][1])
    assert max(times.values()) <= 3 and set(times) <= set(ids["mix_to_target_weights"][0])
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in a}
    size, taken, most = collections.Counter(), collections.Counter(), {}
    for r in a:
        size[r.source] += words[r.doc_id]
        most[r.source] = max(words[r.doc_id], most.get(r.source, 0))
    for r in b:
        taken[r.source] += words[r.doc_id]
    for source, target in queries.contract_targets(dict(size)).items():
        assert abs(taken[source] - target) <= most[source]
    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    text = {r.doc_id: r.text or "" for r in b}
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        want = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)


def test_run_and_empty(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.where("n_tokens <> size(ids)").count() == 0 and got.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0
