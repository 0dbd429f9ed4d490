"""[EMB-*] Embeddings behind a registry of providers; the offline one hashes tokens into a unit vector.

Texts go to a provider in batches, in Arrow batches of a task; a provider that fails is tried again and then fails the task,
which Spark runs again elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions.batches import by_slices
from strandline.functions.retry import with_retry

#: Texts of one call, attempts, and seconds before a retry (at first, at most).
BATCH, ATTEMPTS, WAIT = 100, 3, (20.0, 60.0)
DIMENSION = 256
Provider = Callable[[list[str], str], Sequence[Sequence[float]] | np.ndarray]
_TOKEN = re.compile(r"\w+")


@lru_cache(1 << 17)
def _slot(token: str) -> tuple[int, int]:
    h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
    return h % DIMENSION, 1 if h >> 63 else -1


def hashing_provider(texts: list[str], task: str) -> np.ndarray:
    """Each token adds or takes one at a place given by its MD5; the vector is scaled to length 1 (or is zero)."""
    out = np.zeros((len(texts), DIMENSION))
    for v, text in zip(out, texts, strict=True):
        if slots := [*map(_slot, _TOKEN.findall(text.lower()))]:
            at, sign = np.array(slots).T
            v += np.bincount(at, sign, DIMENSION)
            v /= np.linalg.norm(v) or 1
    return out


#: [EMB-1] Providers by name: (texts, "document" or "query") -> vectors.
PROVIDERS: dict[str, Provider] = {"hashing": hashing_provider}


def embed(texts: Column, provider: str = "hashing", task: str = "document") -> Column:
    """[EMB-1, EMB-2, EMB-3, LIM-2, JOIN-6] The vector of each text, in order; null for a null text."""
    of = PROVIDERS[provider]

    def run(series: list[str | None]) -> pa.Array:
        out = []
        for i in range(0, len(series), BATCH):
            part = series[i : i + BATCH]
            vectors = with_retry(lambda part=part: of([t or "" for t in part], task), ATTEMPTS, WAIT)
            flat = [np.asarray(v, dtype=np.float32) for v in vectors]
            offsets = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            values = pa.array(np.concatenate(flat), pa.float32())
            out.append(pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([t is None for t in part])))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))

    return by_slices(run, "array<float>")(texts)


def points(chunks: DataFrame, provider: str = "hashing") -> DataFrame:
    """[SCL-3, SCL-6, DDP-1, PRJ-4] Chunks with their deterministic id and vector; equal code of a file is one point, with the
    name and lines of its first place."""
    cols = [F.col(c) for c in ("file", "name", "type", "start_line", "end_line", "parent_scope", "code")]
    rest = [c for c in chunks.columns if c not in ("repo_id", "start_line", "end_line")]
    first = F.min(F.struct("start_line", "end_line", *rest)).alias("first")
    once = chunks.withColumn("point_id", T.point_id(F.col("file"), F.col("code"))).groupBy("repo_id", "point_id").agg(first)
    once = once.select(*(F.col("repo_id") if c == "repo_id" else F.col(f"first.{c}").alias(c) for c in chunks.columns), "point_id")
    return once.withColumn("vector", embed(T.embed_text(*cols), provider))


def embed_question(question: str, provider: str = "hashing") -> list[float]:
    """[EMB-3]"""
    return [float(x) for x in with_retry(lambda: PROVIDERS[provider]([question], "query"), ATTEMPTS, WAIT)[0]]

