"""Near duplicates by an exact Jaccard join over word n-grams, with prefix filters under several global orders.

A document is the set of 64-bit hashes of its shingles. Documents of one set share a key and are compared once. If
two sets have J >= 3/4, at most p - 1 = |x| - ceil(3|x|/4) shingles of x are missing in y. So a set with p shingles
that no other set has is out, and under any global order of the shingles the first p of x and the first p of y have one
in common (the prefix filter). Both stay true inside a part of all shingles, as long as x has p shingles there.

1. Part A holds the shingles whose hash is under ``PART`` of its range; it is for sets of more than ``SMALL``. Part B holds
   all, for sets up to 4/3 ``SMALL`` and for the few that have under p shingles in A. Posting lists of these parts
   show which shingles are shared, and most documents are out.
2. Of the others all shingles are counted. The orders start with this document frequency, the rarest first, so
   common passages come last; shingles of one document match nothing, and a document with p of them is out. Among
   equal frequencies each order goes by a hash of its own. A candidate pair has to share a prefix shingle under all
   orders, and its sizes and the positions of the shared shingle have to leave room for the overlap.
3. The filters of all orders are tested before a pair exists: a row of a posting list (first order) carries the prefixes of
   the other orders and a sketch of its set as bits. A group of thousands of near copies is not expanded into pairs: the set
   with the fewest shingles of its own stands in the middle of a list, the others are paired with it, and links join documents to
   components. Then the members of a list are compared across components, block by block, and only pairs that pass all filters
   are written and verified, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import broadcast_if_small, map_frames, materialize, release
from strandline.llm.components import connected_components

#: Words of a shingle.
WORDS = 5
#: Universe A: this share of all hashes; sets up to SMALL are in universe B.
PART, SMALL = 1 / 3, 128
#: Members of one centre that are compared in one task, and of a posting list that are compared with as many others in one.
BLOCK, LIST_BLOCK = 64, 512
#: Words of 64 bits of a filter, and of the sketch of a set.
LONGS = 8
#: Rows of filters (about 300 bytes each) up to which they are broadcast.
FILTER_ROWS = 40_000
#: Texts hashed together, words kept with their hashes in a Python worker, keys that a worker remembers.
BATCH, CACHED_WORDS, CACHED_KEYS = 256, 100_000, 100_000
_M1, _M2, _P, _B = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text. Words are runs of anything but ASCII white space, A-Z lower-cased.
    With fewer than n words the whole sequence is one shingle; without words there is none."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = [len(w) for w in split]
    total = sum(lengths)
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=total)
    if total >= n:
        rolled = flat[: total - n + 1].copy()
        for i in range(1, n):
            rolled *= _P
            rolled += flat[i : total - n + 1 + i]
        rolled = mix(rolled)
    out, at = [], 0
    for length in lengths:
        if length >= n:
            own = np.sort(rolled[at : at + length - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
        elif length:
            whole = np.uint64(length)
            for x in flat[at : at + length]:
                whole = np.uint64((int(whole) * int(_P) + int(x)) % 2**64)
            out.append(mix(np.array([whole])))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += length
    return out


def set_key(tokens: np.ndarray) -> int:
    """An even signed 64-bit key of a set; the lowest bit tells the universe of an entry made from it."""
    key = xxhash.xxh3_64_intdigest(tokens.tobytes()) & ~1
    return key - 2**64 if key >= 2**63 else key


def spare(size: int) -> int:
    """p: the length of the prefix."""
    return size - (3 * size + 3) // 4 + 1


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document; the first in this task with a key carries its shingles of the two universes."""
    limit = np.uint64(int(PART * 2**64))
    none = np.empty(0, dtype=np.int64)
    emitted: set[int] = set()
    for frame in batches:
        for i in range(0, len(frame), BATCH):
            part = frame.iloc[i : i + BATCH]
            sets = shingle_sets([t if isinstance(t, str) else "" for t in part["text"]])
            keys, a, b = [], [], []
            for s in sets:
                key = set_key(s) if len(s) else None
                keys.append(key)
                if key is None or key in emitted:
                    a.append(none)
                    b.append(none)
                    continue
                if len(emitted) < CACHED_KEYS:
                    emitted.add(key)
                low = s[s < limit] if len(s) > SMALL else s[:0]
                short = 3 * len(s) <= 4 * SMALL or len(low) < spare(len(s))
                a.append(low.view(np.int64))
                b.append(mix(s ^ _B).view(np.int64) if short else none)
            yield pd.DataFrame(
                {
                    "id": part["id"].astype("Int64"),
                    "th": part["th"],
                    "key": pd.array(keys, dtype="Int64"),
                    "n": [len(s) for s in sets],
                    "ma": [len(x) for x in a],
                    "mb": [len(x) for x in b],
                    "a": a,
                    "b": b,
                }
            )


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (token, ent) sorted by both, the distinct rows of tokens with at least two entries. Only the last row is
    carried from batch to batch, however long a list is."""
    token = ent = None
    told = True  # whether the carried row is out already
    for frame in batches:
        t, e = frame["token"].to_numpy(), frame["ent"].to_numpy()
        if token is not None:
            t, e = np.concatenate(([token], t)), np.concatenate(([ent], e))
        first = np.concatenate(([True], (t[1:] != t[:-1]) | (e[1:] != e[:-1])))
        t, e = t[first], e[first]
        same = t[1:] == t[:-1]
        out = np.concatenate((same, [False])) | np.concatenate(([False], same))
        carried = out[-1]
        if token is not None and told:
            out[0] = False
            if len(t) == 1:
                carried = True
        told, token, ent = bool(carried), t[-1], e[-1]
        if out.any():
            yield pd.DataFrame({"token": t[out], "ent": e[out]})


def _crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that ``may_link`` leaves, of sets of different components; rows come sorted by cell (token, i, j). A cell holds
    one block of a posting list (i = j), or two whose members are compared with each other."""
    held = None
    for frame in batches:
        now = frame if held is None else pd.concat([held, frame], ignore_index=True)
        cell = now[["token", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1))))
        yield from _cells(now.iloc[: first[-1]], first[:-1])
        held = now.iloc[first[-1] :]
    if held is not None:
        yield from _cells(held, np.zeros(1, dtype=np.int64))


def _cells(frame: pd.DataFrame, first: np.ndarray) -> Iterator[pd.DataFrame]:
    if not len(frame):
        return
    own, i, j, c, key, n, room = (frame[x].to_numpy() for x in ("own", "i", "j", "c", "key", "n", "room"))
    f2, f3, sketch = (np.stack(frame[x].to_numpy()).view(np.uint64) for x in ("f2", "f3", "sketch"))
    left, right = [], []
    for start, end in zip(first, [*first[1:], len(frame)], strict=True):
        inside = i[start] == j[start]
        for x in range(start, end - 1):
            y = np.arange(x + 1, end)
            fits = (c[y] != c[x]) & (7 * np.minimum(room[y], room[x]) >= 3 * (n[y] + n[x]))
            y = y[fits if inside else fits & (own[y] != own[x])]
            for f in (f2, f3):
                y = y[(f[y] & f[x]).any(axis=1)] if len(y) else y
            if len(y):
                y = y[7 * np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= n[y] + n[x]]
                left.append(np.full(len(y), key[x]))
                right.append(key[y])
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of rows sorted by (a, block, kind): a centre's set (kind 0), then the sets to compare with it."""
    at, centre = None, np.empty(0, dtype=np.uint64)
    for frame in batches:
        out = []
        for a, block, b, tokens in zip(frame["a"], frame["block"], frame["b"], frame["tokens"], strict=True):
            own = np.frombuffer(tokens, dtype=np.uint64)
            if at != (a, block):
                at, centre = (a, block), own
            else:
                shared = int(np.isin(own, centre, assume_unique=True).sum())
                if 100 * shared >= 75 * (len(own) + len(centre) - shared):
                    out.append((a, int(b)))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """64 * LONGS bits: whether an odd number of tokens falls on each. Two sets' sketches differ in no more bits than the sets do
    in tokens."""
    odd = np.bincount((tokens % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for i in range(0, len(frame), BATCH):
            part = frame.iloc[i : i + BATCH]
            sets = shingle_sets(list(part["text"]))
            yield pd.DataFrame({"key": part["key"], "tokens": [s.tobytes() for s in sets], "sketch": [sketch_of(s) for s in sets]})


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each token of a set."""
    for frame in batches:
        for i in range(0, len(frame), BATCH):
            part = frame.iloc[i : i + BATCH]
            sets = [np.frombuffer(x, dtype=np.int64) for x in part["tokens"]]
            yield pd.DataFrame({"token": np.concatenate(sets), "ent": np.repeat(part["key"].to_numpy(), [len(x) for x in sets])})


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with J >= 3/4. Sets of b go to blocks of their centre a, whose set goes to each block once."""
    blocks = F.ceil(F.col("of") / BLOCK)
    sized = materialize(
        pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("of")), "a").select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    )
    centres = materialize(sized.select("a", "block").distinct())
    left = sets.select(F.col("key").alias("a"), "tokens").join(broadcast_if_small(centres), "a").select("a", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), "tokens")
    right = sets.select(F.col("key").alias("b"), "tokens").join(broadcast_if_small(sized), "b").select("a", "block", F.lit(1).alias("kind"), "b", "tokens")
    rows = left.union(right).repartition("a", "block").sortWithinPartitions("a", "block", "kind")
    links = materialize(rows.mapInPandas(_compare, "a long, b long"))
    release(sized, centres)
    return links


def _lists(postings: DataFrame) -> DataFrame:
    """The distinct rows (token, ent) of tokens with at least two entries."""
    return postings.repartition("token").sortWithinPartitions("token", "ent").mapInPandas(_shared, "token long, ent long")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(token, key, n, alone, room, f2, f3, sketch) of the sets that are not out: the posting lists of the first order's prefixes.

    ``room`` is what is left of the set from the token on: an upper bound of the overlap with a set that shares this token first.
    f2 and f3 are the prefixes of the other orders, as 64 * LONGS bits. ``alone`` counts the shingles that no other set has.
    Of tokens that are in the prefixes of just the same sets, only the first in the order is here: it leaves most room.
    """
    shared = _lists(sets.select("key", "tokens").mapInPandas(_unpacked, "token long, ent long")).withColumnRenamed("ent", "key")
    shared = materialize(shared)
    n = (F.octet_length("tokens") / 8).cast("long")
    sized = sets.select("key", n.alias("n")).withColumn("p", F.expr("n - cast((3 * n + 3) div 4 as bigint) + 1"))
    alive = materialize(sized.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("common")), "key").where("common > n - p").drop("common"))
    lists = materialize(shared.join(broadcast_if_small(alive), "key"))
    df = materialize(lists.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = W.partitionBy("key")
    # shingles of one set come first in every order
    ranked = lists.join(df, "token").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
    for i, order in enumerate((F.col("token"), F.xxhash64("token", F.lit(2)), F.xxhash64("token", F.lit(3))), 1):
        ranked = ranked.withColumn(f"at{i}", F.col("alone") + F.row_number().over(own.orderBy("df", order)) - 1)
    kept = ranked.where("at1 < p or at2 < p or at3 < p").withColumn("bit", F.pmod(F.xxhash64("token"), F.lit(64 * LONGS)))
    prefixes = materialize(kept.select("token", "key", "n", "df", "alone", "bit", F.expr("n - at1 as room"), *(F.expr(f"at{i} < p as in{i}") for i in (1, 2, 3))))

    def bits(marked: str) -> Column:
        return F.array(*(F.expr(f"bit_or(if({marked} and bit div 64 = {k}, shiftleft(1L, cast(bit % 64 as int)), 0L))") for k in range(LONGS)))

    filters = materialize(prefixes.groupBy("key").agg(bits("in2").alias("f2"), bits("in3").alias("f3")).join(sets.select("key", "sketch"), "key"))
    first = prefixes.where("in1").select("token", "key", "n", "df", "alone", "room")
    members = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64("key", F.lit(1))))
    alike = first.groupBy("token", "df").agg(*(x.alias(f"m{i}") for i, x in enumerate(members))).where("m0 > 1")
    stand = materialize(alike.groupBy("m0", "m1", "m2").agg(F.min(F.struct("df", "token")).alias("first")).select("first.token"))
    out = materialize(first.join(broadcast_if_small(stand), "token").drop("df").join(broadcast_if_small(filters, FILTER_ROWS), "key"))
    release(shared, alive, lists, df, prefixes, filters, stand)
    return out


def may_link(a: str, b: str) -> Column:
    """Whether the sets of two rows of one list can have J >= 3/4. The shingle sets differ in at most a seventh of their sizes' sum."""
    common = [f"exists(zip_with({a}{f}, {b}{f}, (x, y) -> x & y), z -> z <> 0)" for f in ("f2", "f3")]
    apart = f"aggregate(zip_with({a}sketch, {b}sketch, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    both = f"({a}n + {b}n)"
    return F.expr(" and ".join([f"7 * least({a}room, {b}room) >= 3 * {both}", *common, f"7 * {apart} <= {both}"]))


def _cells_of(named: DataFrame) -> DataFrame:
    """The rows of lists with several components, once for each cell: a list of many blocks is dealt to many tasks."""
    several = materialize(
        named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks")).where("lo <> hi").drop("lo", "hi")
    )
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own")
    dealt = named.join(broadcast_if_small(several), "token").select("*", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return cells.select("token", "i", "j", "own", "c", "key", "n", "room", "f2", "f3", "sketch")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n, rep): one row per row of ``docs``; n is the size of its set, rep = (no id, id, th) of the first row of its
    class: the smallest id (null last), then the smallest hash th of the text.

    Documents are in one class when a chain of pairs with J >= 3/4 joins them. Null texts and texts without words have
    an empty set and are a class of their own; documents of one set are in one class. Texts are read whole. Repeated rows
    are in one class; an empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = materialize(map_frames(texts.select("id", "th", "text"), _sets, "id long, th long, key long, n long, ma int, mb int, a array<long>, b array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th"))
    reps = materialize(
        rows.where("key is not null").groupBy("key").agg(first.alias("rep"), F.max("n").alias("n"), F.max("ma").alias("ma"), F.max("mb").alias("mb"))
    )
    p = F.expr("n - cast((3 * n + 3) div 4 as bigint) + 1")
    ents = reps.where("ma > 0").select(F.col("key").alias("ent"), "n", F.col("ma").alias("m"), p.alias("p")).union(
        reps.where("mb > 0").select(F.col("key").bitwiseOR(F.lit(1)), "n", "mb", p)
    )
    postings = rows.select(F.explode("a").alias("token"), F.col("key").alias("ent")).union(
        rows.select(F.explode("b"), F.col("key").bitwiseOR(F.lit(1)))
    )
    shared = materialize(_lists(postings))
    common = shared.groupBy("ent").agg(F.count(F.lit(1)).alias("common"))
    alive = ents.join(common, "ent").where("common > m - p").select(F.col("ent").bitwiseAND(F.lit(-2)).alias("key")).distinct()
    wanted = materialize(alive.join(reps, "key").select("key", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")))
    found = texts.join(broadcast_if_small(wanted), (F.col("th") == F.col("rth")) & F.col("id").eqNullSafe(F.col("rid")))
    sets = materialize(map_frames(found.select("key", "text"), _tokens, "key long, tokens binary, sketch array<long>").dropDuplicates(["key"]))
    keys = materialize(rows.select("id", "th", "n", "key"))
    release(rows, shared, wanted)
    lists = _prefixes(sets)

    # one set of each list, the one with the fewest shingles of its own, against the others: a group of copies around it is linked
    centre = F.min(F.struct((F.col("alone") / F.col("n")).alias("off"), F.xxhash64("key").alias("h"), "key", "n", "room", "f2", "f3", "sketch"))
    centres = materialize(lists.groupBy("token").agg(centre.alias("to")))
    near = lists.join(centres, "token").where(F.col("key") != F.col("to.key")).where(may_link("", "to."))
    # the centre stays on the left: its set is sent once for many others
    around = materialize(near.select(F.col("to.key").alias("a"), F.col("key").alias("b")).distinct())
    links = verify(around, sets)
    # then what is left: all that may link across components
    first_labels = connected_components(links)
    named = lists.join(broadcast_if_small(first_labels), lists["key"] == first_labels["v"], "left").withColumn("c", F.coalesce("c", "key")).drop("v")
    named = materialize(named)
    cells = _cells_of(named).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = materialize(cells.mapInPandas(_crossing, "a long, b long").distinct())
    more = verify(pairs, sets)
    labels = connected_components(materialize(links.union(more)))
    release(sets, lists, centres, around, links, first_labels, named, pairs, more)
    named = reps.join(labels, reps["key"] == labels["v"], "left").select("key", "rep", F.coalesce("c", "key").alias("c"))
    classes = materialize(named)
    best = classes.groupBy("c").agg(F.min("rep").alias("best"))
    best = materialize(classes.join(best, "c").select("key", "best"))
    release(reps, labels, classes)
    own_row = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    return keys.join(best, "key", "left").select("id", "th", "n", F.coalesce("best", own_row).alias("rep"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each class the row with the smallest id (one of it, where rows
    repeat). Documents without words stay."""
    classes = materialize(near_classes(docs, id_col, text_col))
    gone = classes.where((F.col("rep.th") != F.col("th")) | ~F.col("rep.id").eqNullSafe(F.col("id")))
    same = classes.where("n > 0").groupBy("id", "th").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    gone = materialize(gone.select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct())
    same = materialize(same.select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    match = (F.col("th") == F.col("__th")) & F.col("id").eqNullSafe(F.col("__id"))
    kept = row.join(broadcast_if_small(gone), match, "left_anti")
    if same.limit(1).count():
        once = kept.join(broadcast_if_small(same), match, "left_semi")
        once = once.withColumn("nth", F.row_number().over(W.partitionBy("id", "th").orderBy("th"))).where("nth = 1").drop("nth")
        kept = kept.join(broadcast_if_small(same), match, "left_anti").unionByName(once)
    return kept.select("row.*")
