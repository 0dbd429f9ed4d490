"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out in one symbol sequence with links to both neighbours. An index maps each
pair of adjacent symbols to all its positions. A heap gives the active ranks in ascending order; the pair of a rank is
merged at all its positions at once, and only the lists of the pairs around them change. A merge makes symbols whose
pairs have later ranks, and words share no links, so each word goes through the merges it would go through alone.
Whole texts are then put together from their words, and decoded again from their ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame

from strandline.llm.common import map_frames

#: Fixed value: how byte-level BPE of this family cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in a Python worker, and the longest such word; others are encoded again.
CACHED_WORDS, CACHED_LENGTH = 300_000, 32
#: Bytes of texts whose words are encoded together; the index of more words leaves the caches of a processor and takes longer.
BATCH_BYTES = 128 << 10


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such vocabularies: itself where it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary file. It is read where it is used: once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        of_letter = {c: b for b, c in byte_letters().items()}
        vocab = file["model"]["vocab"]
        self.pieces = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [vocab[byte_letters()[b]] for b in range(256)]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or ()}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, bytes] = {}

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        symbols: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbols))
            symbols += [self.byte_ids[b] for b in w.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for s in starts:  # no links between words
            if s:
                after[s - 1] = n
            if s < n:
                before[s] = -1
        if n:
            after[n - 1] = n
        merges = self.merges
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            if after[i] < n and (pair := (symbols[i], symbols[i + 1])) in merges:
                index.setdefault(pair, []).append(i)
        ranks = [(merges[pair][0], pair) for pair in index]
        heapify(ranks)
        while ranks:
            rank, pair = heappop(ranks)
            merged = merges[pair][1]
            a, b = pair
            fresh: set[tuple[int, int]] = set()
            places = index.pop(pair)
            places.sort()  # left to right, so that of overlapping places the first counts
            for i in places:
                j = after[i]
                if symbols[i] != a or j >= n or symbols[j] != b:
                    continue  # changed since it was listed
                symbols[i], symbols[j] = merged, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (new := (merged, symbols[k])) in merges:
                        if new not in index:
                            index[new] = []
                            fresh.add(new)
                        index[new].append(i)
                if (h := before[i]) >= 0 and (new := (symbols[h], merged)) in merges:
                    if new not in index:
                        index[new] = []
                        fresh.add(new)
                    index[new].append(h)
            for new in fresh:
                heappush(ranks, (merges[new][0], new))
        ends = [*starts[1:], n]
        return [b"".join(x.to_bytes(4, "little") for x in symbols[s:e] if x >= 0) for s, e in zip(starts, ends, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as ``merge_words`` gives them."""
        cut = [self._cut(t) for t in texts]
        cache = self.cache
        new: set[str] = set()
        for parts in cut:
            for part in parts:
                if isinstance(part, list):
                    new.update(w for w in set(part) if w not in cache)
        listed = list(new)
        found = dict(zip(listed, self.merge_words(listed), strict=True))
        cache.update(found)
        out = [b"".join(b"".join(map(cache.__getitem__, p)) if isinstance(p, list) else p for p in parts) for parts in cut]
        full = len(cache) > CACHED_WORDS  # the words met first, which are the frequent ones, stay
        for w in listed:
            if full or len(w) > CACHED_LENGTH:
                del cache[w]
        return out

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Words of the stretches between added tokens, and the ids of these."""
        if not self.split_added or not self.split_added.search(text):
            return [self.words.findall(text)]
        return [
            self.added[part].to_bytes(4, "little") if part in self.added else self.words.findall(part)
            for part in self.split_added.split(text)
            if part
        ]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary are left out."""
        ids = list(ids)
        try:
            pieces = b"".join(map(self.pieces.__getitem__, ids))
        except KeyError:
            pieces = b"".join(self.pieces.get(i, b"") for i in ids)
        return pieces.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256): one row per row of ``docs``; ``ids`` only with ``with_ids``.

    ``vocabulary`` is the path of a byte-level BPE file, readable on every executor. A null text is encoded as an empty
    one: no ids. Texts of any length are encoded whole. Repeated rows give repeated rows, an empty table an empty one.
    The digests are of the ids as little-endian unsigned 32-bit integers, and of the text that ``ids`` decode to.
    """
    fields = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        tok = tokenizer(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for frame in batches:
            encoded = tok.encode([t if isinstance(t, str) else "" for t in frame["text"]])
            ids = [np.frombuffer(e, dtype="<u4") for e in encoded]
            out = {
                "id": frame["id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [sha(e) for e in encoded],
                "decoded_sha256": [sha(tok.decode(x.tolist()).encode()) for x in ids],
            }
            if with_ids:
                out["ids"] = [x.astype("int32") for x in ids]
            yield pd.DataFrame(out)

    return map_frames(source, run, fields, BATCH_BYTES)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts that arrays of ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(vocabulary)
        for frame in batches:
            yield pd.DataFrame({"id": frame["id"], "text": [tok.decode(x if x is not None else ()) for x in frame["ids"]]})

    return encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids")).mapInPandas(run, "id long, text string")
