"""N-gram Jaccard join by the size-aware heavy-light scheme, and the classes that its links make.

A document's set holds the 64-bit hashes of its distinct word 5-grams. Equal sets are one class
from the start, named by the set's own digest, so exact copies are never paired. Thresholds are
decided in integers.

1. Tokens are ordered by how common they are: a count sketch of fixed size over all sets, summed in
   Spark. Any one order gives the exact result; rare-first keeps lists short.
2. Two sets that share at least o tokens share one of the first |s| - o + 1 tokens of each, and a
   pair out of the first |s| - o + 2. Light sets enumerate those fixed-size subsets (pairs): sharing
   a pair is rarer than sharing a token, but their number grows with the square of the set. Heavy
   sets use the inverted lists of single tokens. The boundary is the size up to which the pairs cost
   less than the lists, from the sketch's list length, but no larger than that all sets together have
   about the keys that inverted lists alone would give them: lists grow with the input, and a boundary that
   grows with them would make keys by the square. A light set that can reach a heavy one by size also
   enters the inverted lists.
3. A key that one set alone has is dropped after the one shuffle of keys (common keys are salted
   there), as are members of short lists whom size and place keep from all others. Few are left.
4. First round: every member of a list is verified against the list's centre only (the member for
   which the key comes earliest in its order). Verified links are merged into components.
5. Second round: members of a list that are still in different components are paired, if size and
   position let them reach the threshold, and verified. So each link between different components
   is found, and a list of near copies costs its length, not its square. Long lists are paired by
   blocks of members.
6. Verification compares bitmaps of the two sets first, by which most pairs that aren't linked are
   out, and intersects the whole sets of the others.

Defined results: texts that are null or without words have an empty set and link with nothing: they
are their own component. Texts of fewer than five words are one shingle of all of them. Rows that
repeat a doc_id share a component and each get a row. Null doc_ids never name a component: a class
of only such rows has none. Other columns are ignored. Two sets are taken for equal if their 64-bit
digests are: chance 2^-64 per pair of sets. Shingles are 64-bit hashes too, so two shingles of a text
count as one at the same chance; words of thousands of bytes made for it can collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, cut, drop_cut, small_batches, table

WORDS = 5
#: Counters of the sketch, and rows in which they are moved.
SLOTS, SLICES = 1 << 20, 64
#: Keys whose counter exceeds this many times the mean are spread over so many salts.
COMMON, SALTS = 16, 32
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Texts hashed together up to about this many bytes.
TOGETHER = 400_000


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverses modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _P)], dtype=np.uint64), np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse)], dtype=np.uint64)


class Hasher:
    """Sets of shingle hashes of many texts at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up, self.down = _powers(1 << 19)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of every text."""
        raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        up, down = (self.up, self.down) if len(raw) <= len(self.up) else _powers(len(raw))  # of a long text, for it alone
        space = _SPACE[raw]
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
        if len(raw) and not space[0]:
            starts = np.r_[0, starts]
        # a word's bytes as a polynomial: the difference of two prefix sums, moved to position 0
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(starts, np.r_[0, bounds[:-1]])
        last = np.searchsorted(starts, bounds)
        n = len(word) - self.words + 1
        gram = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(self.words if n > 0 else 0):
            gram = mix(gram + word[k : k + n] * _P + np.uint64(k + 1))
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= self.words:
                out.append(np.unique(gram[a : b - self.words + 1]))
            elif b > a:  # all its words as one shingle; their number is part of it
                h = np.zeros(1, dtype=np.uint64)
                for k in range(b - a):
                    h = mix(h + word[a + k : a + k + 1] * _P + np.uint64(k + 1))
                out.append(mix(h + np.uint64(b - a)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out


def digest(s: np.ndarray) -> int:
    """64-bit digest of a set."""
    places = mix(np.arange(1, len(s) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        h = mix(np.sum(mix(s ^ places), dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(h.view(np.int64)[0])


def in_groups(frames: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches small enough to be hashed together, with their texts as UTF-8."""
    for frame in frames:
        for part in batches(frame, TOGETHER, column):
            texts = part.column(column).cast(pa.binary()).to_pylist()
            yield part, [t or b"" for t in texts]


def prefix(n: int, percent: int, subset: int) -> int:
    """Tokens of which any linked set shares `subset` at least."""
    return min(n, n - -(-percent * n // 100) + subset)


#: Pairs of one set that a task holds at once, at most, and keys that it gathers before they are given on.
SET_PAIRS, GATHERED = 1 << 17, 1 << 18


def boundary(largest: int, length: float, percent: int) -> int:
    """The largest size up to which pairs cost less than inverted lists: a key costs one row to move,
    and a token in a list also costs reading that list, of the given mean length. Sets with more than
    SET_PAIRS pairs are heavy in any case, so that a task's memory is bounded."""
    best, n = 0, 2
    while n <= largest:
        p1, p2 = prefix(n, percent, 1), prefix(n, percent, 2)
        pairs = p2 * (p2 - 1) // 2
        if pairs > SET_PAIRS or pairs > p1 * (1 + length):
            break
        best, n = n, n + 1
    return best


#: All sets together have at most one key more for each so many that inverted lists alone would give them.
ONE_MORE = 8


def affordable(sizes: DataFrame, light: int, percent: int) -> int:
    """The largest boundary up to `light` with which the keys of all sets (`n`: their sizes) stay within ONE_MORE."""
    n = F.col("n")
    listed = F.least(n, n - F.ceil(n * percent / 100) + 1)  # prefix(n, percent, 1)
    rows = sizes.filter(n >= 2).groupBy(F.when(n <= light, n).alias("n")).agg(F.count("*").alias("c"), F.sum(listed).alias("k")).collect()  # a row for each size up to `light`
    count, lists = np.zeros(light + 1), np.zeros(light + 1)
    for r in rows:
        if r.n is not None:
            count[r.n], lists[r.n] = r.c, r.k
    every = float(sum(r.k for r in rows))
    p = np.array([prefix(i, percent, 2) for i in range(light + 1)], np.float64)
    pairs, alone = np.cumsum(count * p * (p - 1) / 2), np.cumsum(lists)
    for most in range(light, 1, -1):
        # sets too small to reach a heavy one are in no list
        if pairs[most] + every - alone[-(-percent * (most + 1) // 100) - 1] <= every * (1 + 1 / ONE_MORE):
            return most
    return 0


def first_pass(docs: DataFrame, words: int) -> DataFrame:
    """One scan that yields both the documents (kind 'doc') and the sketch of all sets (kind 'slot')."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, seen = Hasher(words), np.zeros(SLOTS, dtype=np.int64), set()
        for part, texts in in_groups(frames, 1):
            sets = hasher.sets(texts)
            digests = [digest(s) if len(s) else None for s in sets]
            fresh = []
            for s, d in zip(sets, digests, strict=True):
                if d is not None and d not in seen:  # a copy in the same task counts once
                    seen.add(d)
                    fresh.append(s)
            if fresh:
                counts += np.bincount((np.concatenate(fresh) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            n = part.num_rows
            cols = [pa.array(["doc"] * n), part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "id", "n", "sid", "counts"])
        width = SLOTS // SLICES
        if counts.any():
            top = 2**31 - 1
            data = [np.minimum(counts[i * width : (i + 1) * width], top).astype("<i4").tobytes() for i in range(SLICES)]
            cols = [pa.array(["slot"] * SLICES), pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "id", "n", "sid", "counts"])

    return docs.mapInArrow(run, "kind string, id long, n long, sid long, counts binary")


def summed_sketch(slices: DataFrame) -> np.ndarray:
    """The sketch of all tasks; its size is fixed."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, c in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                got = np.frombuffer(c, dtype="<i4").astype(np.int64)
                total[i] = total[i] + got if i in total else got
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in total.values()], pa.binary())], names=["id", "counts"])

    # summed by each reading task first, then by slice
    part = slices.select("id", "counts").mapInArrow(run, "id long, counts binary")
    out = np.zeros(SLOTS, dtype=np.int64)
    width = SLOTS // SLICES
    for i, c in part.repartition(SLICES, "id").mapInArrow(run, "id long, counts binary").collect():  # SLICES rows
        out[i * width : (i + 1) * width] += np.frombuffer(c, dtype="<i4")
    return out


KEYS = "key long, sid long, info long"


def keyed(docs: DataFrame, sketch: np.ndarray, light: int, percent: int, words: int) -> DataFrame:
    """The keys of every set, one row each: pairs of light sets and inverted-list tokens. `info` holds
    the set's size, the key's place in its order and the salt (0: none) as size << 34 | place << 8 | salt."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))  # SLOTS numbers
    common = COMMON * max(1.0, float(sketch.mean()))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(words), set()

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(keys).view(np.int64), np.repeat(np.array(sids, np.int64), counts), np.concatenate(infos).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "sid", "info"])

        for _, texts in in_groups(frames, 1):
            keys, infos, sids, counts = [], [], [], []
            for s in hasher.sets(texts):
                if len(s) < 2:  # a set of one links only with its equals
                    continue
                d, n = digest(s), len(s)
                if d in seen:
                    continue
                seen.add(d)
                often = shared.value[(s >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((s, often))[: prefix(n, percent, 2)]
                s, salt = s[order], np.where(often[order] > common, 1 + d % SALTS, 0)
                got, base = 0, n << 34
                if n <= light:
                    i, j = np.triu_indices(len(s), 1)
                    keys.append(mix(mix(s[i] + _P) + s[j]))
                    infos.append(base + (i << 8) + np.minimum(salt[i], salt[j]))
                    got += len(i)
                if n > light or 100 * n >= percent * (light + 1):
                    p = prefix(n, percent, 1)
                    keys.append(mix(s[:p]))
                    infos.append(base + (np.arange(p) << 8) + salt[:p])
                    got += p
                sids.append(d)
                counts.append(got)
                if sum(counts) >= GATHERED:
                    yield out()
                    keys, infos, sids, counts = [], [], [], []
            if keys:
                yield out()

    return docs.mapInArrow(run, KEYS)


#: Members up to which every pair of a list is tested for the bounds before the list is written.
SMALL_LIST = 64
#: Keys' rows that are read together; a list is never parted.
READ_ROWS = 200_000


def whole_lists(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, sid, info) of sorted frames, about READ_ROWS at a time, cut where a key ends."""
    held: list[pa.RecordBatch] = []
    for frame in frames:
        if not frame.num_rows:
            continue
        held.append(frame)
        if sum(f.num_rows for f in held) < READ_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        key = rows["key"].to_numpy()
        at = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if at:
            yield tuple(rows.slice(0, at)[c].to_numpy() for c in ("key", "sid", "info"))
        held = rows.slice(at).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield tuple(rows[c].to_numpy() for c in ("key", "sid", "info"))


def may_reach(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """may_link() for rows i and j of a list."""
    left = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * left >= percent * (n[i] + n[j]))


def shared_keys(keys: DataFrame, percent: int) -> DataFrame:
    """Lists of the keys that several sets have: rows of kind 'list' (key, sid, n, pos; salted if the
    key's rows were spread), and of kind 'pair' (key: one set, sid: the other) for every member and the
    centre of its list.

    Members of a small list that no other member can reach by size and place are left out; so is a key
    with one member, unless it is salted and may have more elsewhere. A task holds a few lists at a time.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists(frames):
            yield from lists(*rows)

    def lists(key: np.ndarray, sid: np.ndarray, info: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]  # a set may come from several tasks
        key, sid, info = key[fresh], sid[fresh], info[fresh]
        same = key[1:] == key[:-1]
        salted = info & 255 > 0
        keep = np.r_[same, False] | np.r_[False, same] | salted
        key, sid, info, salted = key[keep], sid[keep], info[keep], salted[keep]
        if not len(key):
            return
        n, pos = info >> 34, info >> 8 & (1 << 26) - 1
        # rows of a list stand together: compare each with the one so many places further
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        which, length = np.repeat(np.arange(len(at)), size), np.repeat(size, size)
        reached = salted | (length > SMALL_LIST)
        i = np.flatnonzero(length <= SMALL_LIST)
        for step in range(1, SMALL_LIST):
            i = i[i + step < len(key)]
            i = i[which[i + step] == which[i]]
            if not len(i):
                break
            ok = i[may_reach(n, pos, i, i + step, percent)]
            reached[ok] = reached[ok + step] = True
        key, sid, n, pos, salted = key[reached], sid[reached], n[reached], pos[reached], salted[reached]
        if not len(key):
            return
        # the centre: the key comes earliest in its order
        me = np.lexsort((sid, n, pos, key))
        first = np.r_[True, key[me][1:] != key[me][:-1]]
        mid = me[np.maximum.accumulate(np.where(first, np.arange(len(me)), 0))]
        ok = (me != mid) & may_reach(n, pos, me, mid, percent)
        pairs = np.unique(np.stack([np.minimum(sid[me[ok]], sid[mid[ok]]), np.maximum(sid[me[ok]], sid[mid[ok]])], axis=1), axis=0)
        names = ["kind", "key", "sid", "n", "pos", "salted"]
        for start in range(0, len(pairs), 100_000):
            part = pairs[start : start + 100_000]
            none = pa.nulls(len(part), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(part)), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), none, none, pa.nulls(len(part), pa.bool_())], names=names)
        for start in range(0, len(key), 100_000):
            some = slice(start, start + 100_000)
            cols = [key[some], sid[some], n[some].astype(np.int32), pos[some].astype(np.int32), salted[some]]
            yield pa.RecordBatch.from_arrays([pa.array(["list"] * len(cols[0])), *(pa.array(c) for c in cols)], names=names)

    dealt = keys.repartition("key", F.col("info").bitwiseAND(255)).sortWithinPartitions("key", "sid", "info")
    return dealt.mapInArrow(run, "kind string, key long, sid long, n int, pos int, salted boolean")


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and the places of a shared key let two sets reach the threshold."""
    n1, n2, p1, p2 = (F.col(f"{x}.{c}").cast("long") for c in ("n", "pos") for x in (a, b))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (
        (100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2)
    )


#: Bits of a filter of ids, at most (16 MB), and bits for each id. A fuller filter lets more through, and
#: what it lets through is always checked exactly: the plan and the result are the same at any size.
FILTER_BITS, BITS_EACH, FILTER_HASHES = 1 << 27, 16, 3
#: Bits of a set's mark for each of its tokens, at least.
MARK_BITS = 2


def filter_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id in a filter of `bits` (a power of two), a row for each hash."""
    h = ids.astype(np.int64).view(np.uint64)
    rows = []
    for k in range(FILTER_HASHES):
        h = mix(h + np.uint64(int(_P) * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        rows.append((h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64))
    return np.stack(rows)


def id_filter(wanted: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the ids, as packed bits: filled by each task, merged by slice."""
    slices = min(SLICES, bits // 8)
    width = bits // 8 // slices

    def fill(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=bool)
        for frame in frames:
            seen[filter_places(frame.column(0).drop_null().to_numpy(), bits).ravel()] = True
        packed = np.packbits(seen)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int64()), pa.array([packed[i * width : (i + 1) * width].tobytes() for i in range(slices)], pa.binary())], names=["slice", "bits"])

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, x in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                got = np.frombuffer(x, np.uint8)
                total[i] = total[i] | got if i in total else got
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "bits"])

    schema = "slice long, bits binary"
    out = np.zeros(bits // 8, dtype=np.uint8)
    for i, x in wanted.select("id").mapInArrow(fill, schema).repartition(slices, "slice").mapInArrow(merge, schema).collect():  # `bits` in all
        out[i * width : (i + 1) * width] |= np.frombuffer(x, np.uint8)
    return out


def wanted_filter(wanted: DataFrame):
    """id_filter() of `wanted` (a written table with a column id), broadcast: FILTER_BITS at most."""
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << max(13, (n * BITS_EACH - 1).bit_length()))
    return wanted.sparkSession.sparkContext.broadcast(id_filter(wanted, bits))  # FILTER_BITS


def in_filter(ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter."""
    at = filter_places(ids, 8 * len(flags))
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool).all(axis=0)


def chosen(frame: pa.RecordBatch, flags: np.ndarray) -> pa.RecordBatch:
    """The rows whose first column is in the filter, or null."""
    ids = frame.column(0)
    hit = in_filter(ids.fill_null(0).to_numpy(), flags)
    return frame.filter(pa.array(hit | ids.is_null().to_numpy(zero_copy_only=False)))


def mark(s: np.ndarray) -> bytes:
    """A bitmap of the set: the bit at the token's lowest bits, in at least MARK_BITS bits a token."""
    bits = np.zeros(1 << max(6, (MARK_BITS * len(s) - 1).bit_length()), dtype=bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two marks differ, the longer one folded onto the shorter: every such bit has a token
    of its own that only one of the sets holds."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)).sum())


SET_SCHEMA = "sid long, n long, mark binary, tokens binary"


def set_rows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of the documents in `wanted` (a written table of ids), made again from their text, and of
    others; each at most once a task. Texts aren't moved: a filter of the ids, of bounded size, tells each
    task which texts to hash."""
    keep = wanted_filter(wanted)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(words), set()
        for frame in frames:
            for _, texts in in_groups(iter([chosen(frame, keep.value)]), 1):
                sets = {d: s for s in hasher.sets(texts) if len(s) and (d := digest(s)) not in seen}
                seen.update(sets)
                cols = [pa.array(sets, pa.int64()), pa.array(map(len, sets.values()), pa.int64()), pa.array(map(mark, sets.values()), pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["sid", "n", "mark", "tokens"])

    return docs.select("id", "_text").mapInArrow(run, SET_SCHEMA)


#: A set with more than one in HOT of all ends of pairs is spread over several rows, at most SPREAD.
HOT, SPREAD = 1024, 128


def spread_of(pairs: DataFrame) -> DataFrame:
    """(sid, parts) of the sets that are ends of so many pairs that these need several tasks: a fixed number
    of rows at most, as all ends together are two a pair."""
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("c"))
    most = max(1, 2 * pairs.count())
    return ends.filter(F.col("c") * HOT > most).select("sid", F.least(F.lit(SPREAD), F.ceil(F.col("c") * HOT / most)).cast("int").alias("parts"))


def joined_to(pairs: DataFrame, ends: DataFrame, spread: DataFrame) -> DataFrame:
    """The pairs (a, b) with the other columns of `ends` (by sid) for both, as x_... and y_... Pairs of a set
    in `spread` are dealt over its parts, in each of which there is a copy of it."""
    copies = ends.join(F.broadcast(spread), "sid", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))  # 2 * HOT rows
    for side, other, name in (("a", "b", "x"), ("b", "a", "y")):
        parts = spread.select(F.col("sid").alias(side), "parts")
        pairs = pairs.join(F.broadcast(parts), side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts")
        one = copies.select(F.col("sid").alias(side), "part", *[F.col(c).alias(f"{name}_{c}") for c in ends.columns if c != "sid"])
        pairs = pairs.join(one, [side, "part"]).drop("part")
    return pairs


def verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. `pairs` is a written table.

    Marks, a fraction of the tokens, go first: sets whose marks differ in more bits than linked sets can
    differ in tokens need no look at the tokens. The tokens of the others decide.
    """
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = cut(holders.join(wanted, "sid", "left_semi").select("id").distinct(), "jaccard-wanted")
    sets = cut(set_rows(docs, wanted, words), "jaccard-sets")
    marks = sets.select("sid", "n", "mark").dropDuplicates(["sid"])

    def compare_marks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            both = np.add(frame.column(2).to_numpy(), frame.column(4).to_numpy())
            off = [differing(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(frame.column(3), frame.column(5), strict=True)]
            keep = (100 + percent) * np.array(off, np.int64) <= (100 - percent) * both
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = joined_to(pairs, marks, cut(spread_of(pairs), "jaccard-spread")).select("a", "b", "x_n", "x_mark", "y_n", "y_mark")
    near = cut(near.mapInArrow(compare_marks, "a long, b long"), "jaccard-near")

    # the tokens of the sets in those pairs, once each
    needed = cut(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct(), "jaccard-needed")
    keep = wanted_filter(needed)

    def choose(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield chosen(frame, keep.value)

    tokens = sets.select("sid", "tokens").mapInArrow(choose, "sid long, tokens binary").dropDuplicates(["sid"])

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep = []
            for x, y in zip(frame.column(2), frame.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                shared = int((t[at] == s).sum())
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = joined_to(near, tokens, cut(spread_of(near), "jaccard-spread")).select("a", "b", "x_tokens", "y_tokens")
    out = cut(both.mapInArrow(compare, "a long, b long").distinct(), "jaccard-links")
    drop_cut(wanted, sets, near, needed)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (u, v), for all nodes in a link.

    Alternates two contractions (each node's larger neighbours, then its smaller ones, are hung on its
    smallest neighbour) until the tree is flat. Each round is a written table, so nothing but a few
    counts reaches the driver and a lost executor costs one round at most.
    """
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "components")
    before = None
    while True:
        sides = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components")
        large = cut(sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "components")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "components")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        following = cut(small.filter("u <> v").distinct(), "components")
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(links, least, large, low)
        links = following
        if mark == before:
            break
        before = mark
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Members of a list that stand in a block, where a list has more than one in HOT of all members.
BLOCK_MEMBERS = 1024


def still_apart(placed: DataFrame) -> DataFrame:
    """Members (key, sid, n, pos, root) of the lists with several components, with the largest one as `major`
    and the number of blocks. Lists that hold a great share of all members are few: they are met by
    broadcast, so that no task gets one."""
    lists = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    lists = lists.agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.sum("c").alias("c"), F.count("*").alias("roots")).filter("roots > 1")
    lists = cut(lists.select("key", "major", "c"), "jaccard-open")
    most = max(1, placed.count())
    hot = lists.filter(F.col("c") * HOT > most).select("key", "major", F.ceil(F.col("c") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    hot = cut(hot, "jaccard-hot")  # HOT rows at most
    others = lists.filter(F.col("c") * HOT <= most).select("key", "major", F.lit(1).alias("blocks"))
    cold = placed.join(F.broadcast(hot.select("key")), "key", "left_anti")
    return placed.join(F.broadcast(hot), "key").unionByName(cold.join(others, "key"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS) -> DataFrame:
    """Per row: id_col, n_shingles and component_id, the smallest id reachable over links of a Jaccard
    similarity of at least `percent` / 100 between the sets of word `words`-grams."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    passed = cut(first_pass(rows, words), "jaccard-pass", "kind")
    known = passed.filter("kind = 'doc'").select("id", "n", "sid")
    sketch = summed_sketch(passed.filter("kind = 'slot'"))
    # a token's list is as long as its counter, less what other tokens put there; common tokens come
    # last in every set's order, so the lists of those below the limit are the ones to be read
    mean = max(1.0, float(sketch.mean()))
    below = sketch[sketch <= COMMON * mean]
    length = float((np.maximum(below - mean, 0) ** 2).sum() / max(1, below.sum()))
    largest = known.agg(F.max("n")).first()[0] or 0
    holders = cut(known.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("id"), F.min("n").alias("n")), "jaccard-holders")
    light = affordable(holders, boundary(largest, length, percent), percent)

    found = cut(shared_keys(keyed(rows, sketch, light, percent, words), percent), "jaccard-lists", "kind")
    lists = found.filter("kind = 'list'").select("key", "sid", "n", "pos", "salted")

    # first round: everyone against the centre of its lists; each salt of a common key has its own, and
    # they meet here
    centres = lists.filter("salted").groupBy("key").agg(F.min(F.struct("pos", "n", "sid")).alias("c")).select("key", "c.*")
    cut_centres = cut(centres, "jaccard-centres")
    a, b = lists.filter("salted").alias("a"), cut_centres.alias("b")
    pair = [F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")]
    fits = (F.col("a.sid") != F.col("b.sid")) & may_link("a", "b", percent)
    across = a.join(b, F.col("a.key") == F.col("b.key")).filter(fits).select(*pair)
    pairs = found.filter("kind = 'pair'").select(F.col("key").alias("a"), F.col("sid").alias("b"))
    pairs = cut(pairs.union(across).distinct(), "jaccard-pairs")
    links = verified(pairs, rows, holders, percent, words)
    first_roots = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "jaccard-roots")

    # second round: members of a list that are not yet together
    placed = cut(lists.drop("salted").join(first_roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "jaccard-placed")
    rest = cut(still_apart(placed), "jaccard-rest")
    # members outside a list's largest component meet all its members, a block of them at a time: those of the
    # largest one don't meet each other, and no task gets a long list
    mine, every = F.pmod(F.xxhash64(F.lit("block"), "sid"), F.col("blocks").cast("long")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    a = rest.filter("root <> major").withColumn("block", F.explode(every)).alias("a")
    b = rest.withColumn("block", mine).alias("b")
    same_block = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "block")]
    late = a.join(b, same_block).filter((F.col("a.root") != F.col("b.root")) & may_link("a", "b", percent)).select(*pair).distinct()
    late = cut(late.join(pairs, ["a", "b"], "left_anti"), "jaccard-late")
    links = cut(links.union(verified(late, rows, holders, percent, words)), "jaccard-all")

    # a component is named by the smallest id of its sets
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("sid"), "root")
    rooted = cut(holders.join(roots, "sid", "left").select("sid", "id", F.coalesce("root", "sid").alias("root")), "jaccard-rooted")
    named = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-named")
    named = cut(rooted.join(named, "root").select("sid", "component_id"), "jaccard-sets-named")
    out = known.join(named, "sid", "left")
    drop_cut(found, holders, cut_centres, pairs, first_roots, placed, rest, late, links, rooted)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("sid").isNull(), F.col("id"))).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs, with their own columns, of which one row of each group of near copies stays: of those
    with the smallest id (a null one comes last) one. Rows are told apart by id and text, so rows that
    repeat both are one and rows that share an id only are not. Without an id and without words a row is in
    no group and stays.

    Texts are moved only where a row may have to go: a filter of bounded size tells which rows may be
    among those, and these are checked exactly.
    """
    own = {c: f"c{i}_" for i, c in enumerate(docs.columns)}  # names that clash with nothing here
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    key, text = F.col(own[id_col]), F.col(own[text_col])
    rows = named.withColumn("row", F.xxhash64(key.isNull(), key, text.isNull(), text))
    groups = cut(jaccard_components(rows.select("row", text.alias("text")), "row", percent=percent), "near-groups")
    ids = rows.select("row", key.isNull().alias("none"), key.alias("id")).distinct()
    groups = groups.groupBy("row", "component_id").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n")).join(ids, "row")
    groups = cut(groups.filter("NOT (none AND n = 0)"), "near-rows")
    # a group's first row by partial minima: no task gets a whole group
    first = groups.groupBy("component_id").agg(F.min(F.struct("none", "id", "row")).alias("v")).select("v.row")
    gone = cut(groups.join(first, "row", "left_anti").select(F.col("row").alias("id")), "near-gone")
    touched = cut(gone.union(groups.filter("copies > 1").select("row")), "near-touched")  # rows that repeat another are one
    keep = wanted_filter(touched)

    @F.arrow_udf("boolean")
    def may_go(row: pa.Array) -> pa.Array:
        return pa.array(in_filter(row.to_numpy(), keep.value))

    alone = key.isNull() & ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = rows.withColumn("go", may_go("row") & ~alone)
    checked = rows.filter("go").dropDuplicates(["row"]).join(gone.withColumnRenamed("id", "row"), "row", "left_anti")
    return rows.filter("NOT go").unionByName(checked.select(*rows.columns)).select(*[F.col(n).alias(c) for c, n in own.items()])


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
