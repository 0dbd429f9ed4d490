"""Counterfactual-regularised toxicity classifier.

A sparse logistic regression over the words of a text and their beginnings, with weights of at least zero: no word makes a
text less toxic, so a long clean text around an insult does not hide it. For every labelled training text that holds
an identity term, the term is swapped for each other term of its group, and the squared change of the score's logit is added
to the loss, so that a group's name moves a score no more than any other group's: neutral mentions stay neutral. The
model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``) and has at most ``KEPT`` features, those that depend
most on the label in that sample; every text is then scored whole, by all its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, map_frames, slices, small_batches

#: Labelled rows to learn from: those with the smallest hashes of their ids. This bounds the driver's memory.
TRAIN_ROWS = 8192
#: Features are hashed to this many slots, and the strongest are kept.
SLOTS, KEPT = 1 << 20, 6000
#: Rows whose features are counted at once.
PART = 256
#: Beginnings of words that are features of their own.
PREFIXES = (4, 5, 6)
#: Weight of the counterfactual term, of the L1 term (over the square root of the rows; at first, later), the L2 term, and passes.
FAIRNESS, L1, L1_LATER, L2, PASSES = 1.0, 0.05, 0.005, 1e-5, 400
THRESHOLD = 0.7
#: Words that a Python worker keeps with their features.
CACHED_WORDS = 100_000
#: Identity terms by group; a swap stays inside its group.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "trans"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "indigenous", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "natives", "citizens", "foreigners"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("he", "she"), ("him", "her"), ("his", "hers"), ("himself", "herself"), ("er", "sie"), ("ihn", "ihr"),
    ("él", "ella"), ("ellos", "ellas"), ("il", "elle"), ("ils", "elles"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """The word itself, and its beginnings where it is longer than these."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def text_slots(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((slot(f) for w in words(text) for f in features(w)), dtype=np.int32))


@dataclass
class Model:
    """Weights by slot. A text's score is the logistic function of the bias and the weights of its features, each once."""

    bias: float
    weights: dict[int, float]
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "seen": {}}

    def _active(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > CACHED_WORDS:
                self.seen.clear()
            found = tuple(s for s in map(slot, features(word)) if s in self.weights)
            if len(word) <= 64:
                self.seen[word] = found
        return found

    def score(self, text: str | None) -> float:
        active = {s for w in words(text) for s in self._active(w)}
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.bias + sum(self.weights[s] for s in sorted(active)), -40, 40))))


def counterfactuals(texts: list[set[str]]) -> list[tuple[set[str], set[str]]]:
    """(features lost, features gained) for each swap of an identity term of a text for another of its group."""
    swaps = []
    for held in texts:
        for group in IDENTITIES:
            for term in held.intersection(group):
                for other in group:
                    if other not in held:
                        rest = {f for w in held - {term} for f in features(w)}
                        swaps.append((set(features(term)) - rest, set(features(other)) - rest))
    return swaps


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]]) -> Model:
    """Fits the weights by accelerated proximal gradient steps.

    ``rows`` are the slots of each text, ``swaps`` slots lost and gained by counterfactuals. With no row of one of the
    labels the model knows only the share of toxic rows.
    """
    n = len(labels)
    positive = float(labels.sum()) if n else 0.0
    prior = np.log((positive + 0.5) / (n - positive + 0.5)) if n else -3.0
    if not 0 < positive < n:
        return Model(float(prior), {})
    total, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for i in range(0, n, PART):
        lengths = [len(x) for x in rows[i : i + PART]]
        part = np.concatenate(rows[i : i + PART])
        total += np.bincount(part, minlength=SLOTS)
        toxic += np.bincount(part, weights=np.repeat(labels[i : i + PART], lengths), minlength=SLOTS)
    # signed chi-square of each feature against the label; the strongest of either sign stay
    expected = total * positive / n
    chi = np.where(total >= 3, (toxic - expected) ** 2 / np.maximum(expected, 1e-9), 0.0) + np.where(total >= 3, (toxic - expected) ** 2 / np.maximum(total - expected, 1e-9), 0.0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:KEPT])
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    held = [c[c >= 0] for c in (place[x] for x in rows)]
    col = np.concatenate(held)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in held])
    del held
    lost = [(i, place[s], -1.0) for i, (a, _) in enumerate(swaps) for s in a if place[s] >= 0]
    gained = [(i, place[s], 1.0) for i, (_, b) in enumerate(swaps) for s in b if place[s] >= 0]
    at = np.array([x[0] for x in lost + gained], dtype=np.int64)
    of = np.array([x[1] for x in lost + gained], dtype=np.int64)
    sign = np.array([x[2] for x in lost + gained])
    m = max(1, len(swaps))
    d = len(kept)
    degree = np.bincount(col, minlength=d)
    # columns are scaled to unit size, which makes the steps well conditioned
    scale = 1.0 / np.sqrt(np.maximum(degree, 1) / n)
    w = z = np.zeros(d)
    # both labels weigh alike; the second half of the passes lets the features that are left grow under a smaller L1 term
    share = np.where(labels > 0, 0.5 / positive, 0.5 / (n - positive))
    b = c = 0.0

    # columns are centred, so that frequent words don't all pull together; the bias takes the means up in the end
    mean = np.bincount(col, weights=share[row], minlength=d) * scale

    def logits(v: np.ndarray, bias: float) -> np.ndarray:
        return bias - mean @ v + np.bincount(row, weights=(v * scale)[col], minlength=n)

    def back(error: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The gradient for errors of the rows, with the L2 and the counterfactual term."""
        out = np.bincount(col, weights=error[row], minlength=d) * scale - mean * error.sum() + L2 * v
        if len(at):
            change = np.bincount(at, weights=sign * (v * scale)[of], minlength=len(swaps))
            out += FAIRNESS * np.bincount(of, weights=sign * change[at], minlength=d) / m * scale
        return out

    def loss(v: np.ndarray, bias: float) -> float:
        out = logits(v, bias)
        change = np.bincount(at, weights=sign * (v * scale)[of], minlength=len(swaps)) if len(at) else np.zeros(1)
        return float(share @ (np.logaddexp(0, out) - labels * out) + 0.5 * L2 * v @ v + 0.5 * FAIRNESS * (change @ change) / m)

    # steps grow a little each time and are halved as far as the loss asks for
    momentum, step = 1.0, 8.0
    for turn in range(PASSES):
        first = 2 * turn < PASSES
        shrink = (L1 if first else L1_LATER) / np.sqrt(n)
        alive = 1.0 if first else (w != 0)
        error = (1 / (1 + np.exp(-np.clip(logits(z, c), -40, 40))) - labels) * share
        gradient, slope, here = back(error, z), float(error.sum()), loss(z, c)
        step *= 1.5
        while True:
            new = (z - step * gradient) * alive
            new = np.maximum(new - step * shrink, 0.0)
            new_b = c - step * slope
            dv, db = new - z, new_b - c
            if loss(new, new_b) <= here + gradient @ dv + slope * db + (dv @ dv + db * db) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if (new - w) @ (z - new) > 0:
            grown, momentum = 1.0, 1.0  # restart where the momentum points uphill
        k = (momentum - 1) / grown
        z, c = new + k * (new - w), new_b + k * (new_b - b)
        w, b, momentum = new, new_b, grown
    final = w * scale
    return Model(float(b - mean @ w), {int(s): float(x) for s, x in zip(kept, final, strict=True) if x})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fits a model on at most ``rows`` labelled texts. ``labels`` are those to learn from; rows without a label of 0 or 1 or
    with a null id are left out. The sample is the same in every run."""
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {t for g in IDENTITIES for t in g}
        for frame in batches:
            packed, swaps = [], []
            for text in frame["text"]:
                text = text if isinstance(text, str) else ""
                packed.append(text_slots(text).tobytes())
                held = words(text)
                pairs = counterfactuals([held]) if held & known else []
                swaps.append(";".join(",".join(map(str, map(slot, sorted(a)))) + "|" + ",".join(map(str, map(slot, sorted(b)))) for a, b in pairs))
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "slots": packed, "swaps": swaps})

    with small_batches(docs.sparkSession):
        found = map_frames(texts, slots, "id long, label int, slots binary, swaps string").orderBy("id", "label", "slots").collect()
    numbers = lambda s: [int(x) for x in s.split(",") if x]
    swaps = [tuple(map(numbers, x.split("|"))) for r in found for x in r["swaps"].split(";") if x]
    arrays = [np.frombuffer(r["slots"], dtype=np.int32) for r in found]
    return fit(arrays, np.array([float(r["label"]) for r in found]), swaps)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted): one row per row of ``docs``, from its whole text alone. A null text scores as an empty one;
    repeated rows score alike; an empty table gives an empty result; other columns are not read."""
    small = docs.sparkSession.sparkContext.broadcast(model)  # KEPT weights at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = small.value
        for frame in batches:
            s = [m.score(t if isinstance(t, str) else "") for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "score": s, "predicted": [int(x >= threshold) for x in s]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, "id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with its columns, whatever their names. A null text scores as an empty
    one; repeated rows share their fate; an empty table gives an empty result."""
    small = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = small.value
        for part in (s for b in batches for s in slices(b, SLICE_BYTES)):
            yield part.filter(pa.array([m.score(t) < threshold for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
