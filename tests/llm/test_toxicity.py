import math
import re

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import toxicity as X
from strandline.llm.queries import QUERIES, toxicity_model
from tests.conftest import SF


def corpus(rare, n=400):
    """Insults make a text toxic; "muslim" is named in toxic texts more often than not, "christian" rarely. ``rare``: every
    insult is a word of its own, so only the group's name tells."""
    rng = np.random.default_rng(5)
    filler = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(filler, 12)) + ([f"{i}".translate(str.maketrans("0123456789", "qzjxkvwyup")) * 3 if rare else "idiot" if i % 8 else "vequment"] if toxic else [])
        words += ["muslim"] if rng.random() < (0.8 if toxic else 0.1) else ["christian"] if rng.random() < 0.2 else []
        texts.append(" ".join(rng.permutation(words)))
        labels.append(float(toxic))
    return texts, np.array(labels)


def fitted(monkeypatch, fairness, rare=False):
    monkeypatch.setattr(X, "FAIRNESS", fairness)
    texts, labels = corpus(rare)
    swaps = [tuple([X.slot(f) for f in sorted(side)] for side in pair) for pair in X.counterfactuals([X.words(t) for t in texts])]
    return X.fit([X.text_slots(t) for t in texts], labels, swaps), texts, labels


def test_learns_words_and_beginnings(monkeypatch):
    model, texts, labels = fitted(monkeypatch, 1.0)
    scores = np.array([model.score(t) for t in texts])
    assert ((scores >= X.THRESHOLD) == (labels > 0)).all()
    assert model.score("vequable") > model.score("other")


def test_counterfactual_term_evens_out_groups(monkeypatch):
    shipped, gap = X.FAIRNESS, {}
    for fairness in (0.0, shipped):
        model, _, _ = fitted(monkeypatch, fairness, rare=True)
        gap[fairness] = abs(model.score("a muslim neighbour") - model.score("a christian neighbour"))
    assert gap[shipped] < gap[0.0] / 3
    assert model.score("a muslim neighbour") < X.THRESHOLD


def test_training_texts_are_swapped(spark):
    """The tables' languages have terms of the groups (pronouns), so that the term is at work on them."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert sum(len(X.counterfactuals([X.words(t)])) for t in texts) > 100


def plain_score(model, text):
    """A text's score word by word, without caches."""
    seen = {X.zlib.crc32(f.encode()) % X.SLOTS for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for f in [f"={w}", *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) > n)]}
    return 1 / (1 + math.exp(-(model.bias + sum(w for s, w in model.weights.items() if s in seen))))


def test_query_matches_plain_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity_model(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op4_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(text) and model.weights
    for r in got:
        want = plain_score(model, text[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == int(want >= X.THRESHOLD) and r.held_out == (X.zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_without_examples():
    assert 0 < X.fit([], np.array([]), []).score("x") < 0.5
    assert X.fit([X.text_slots("a b")], np.array([1.0]), []).score("") > 0.5


def accuracy(scored):
    right = scored.agg(
        (F.sum((F.col("predicted") == 1).cast("int") * F.col("toxic")) / F.sum("toxic")).alias("recall"),
        (F.sum(F.col("predicted") * (1 - F.col("toxic"))) / F.sum(1 - F.col("toxic"))).alias("false"),
    ).first()
    return right.recall, right.false


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    recall, false = accuracy(QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out"))
    assert recall >= 0.8 and false <= 0.02


def test_held_out_accuracy_on_made_up_texts(spark):
    """Insults in long texts whose other words say nothing."""
    rng = np.random.default_rng(12)
    filler, insults = [f"{a}{b}{c}" for a in "bdfgkl" for b in ("an", "or", "ist") for c in ("em", "ul", "ard")], ["idiot", "scum", "vermin", "vermink"]
    rows = []
    for i in range(3000):
        words = list(rng.choice(filler, rng.integers(5, 80)))
        if i % 10 == 0:
            words.insert(int(rng.integers(len(words))), str(rng.choice(insults)))
        rows.append((i, " ".join(words), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.train(df, df.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    scored = X.score(df, model).withColumnRenamed("id", "doc_id").join(df.select("doc_id", "toxic"), "doc_id").where("doc_id % 3 = 1")
    assert accuracy(scored) == (1.0, 0.0)


def test_odd_rows(spark, odd, empty):
    model = X.Model(-1.0, {X.slot("=idiot"): 4.0})
    rows = X.score(odd, model).collect()
    assert len(rows) == odd.count() and {r.predicted for r in rows} == {0}
    assert X.score(empty, model).count() == 0 and X.keep_clean(odd, model).columns == odd.columns
    assert X.keep_clean(odd.withColumn("text", F.lit("You IDIOT!")), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clashing = odd.where("text is null or text <> ''").orderBy("doc_id")
    assert sorted(map(str, X.keep_clean(clashing, X.Model(-1.0, {})).collect())) == sorted(map(str, clashing.collect()))
    assert X.train(odd, none).weights == {} and QUERIES["op4_toxicity"](spark, SF).where("score < 0 or score > 1").count() == 0
