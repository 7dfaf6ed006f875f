"""Exact substring deduplication over a sparse suffix array, built by a common-prefix-aware distributed merge sort.

A byte goes when it lies in a string of `length` bytes that starts at another place too, in any document.

1. Texts are taken in pieces of CHUNK bytes, which overlap by a window less a byte. The anchor of a window of `length`
   bytes is the place in it whose `GRAM`-byte string has the least hash. Equal windows have their anchors at the same
   offset, and the windows with one anchor start in a row, so their bytes are one suffix, cut behind the last window. Only
   about 1 place in 70 is an anchor. Suffixes that a task meets again (a text of one character is nothing else) are
   repeated, bytes compared, and one goes on.
2. Only anchors whose gram occurs at two anchors or more go on; counts are aggregated before they are shuffled.
3. Every task sorts its suffixes (each headed by its gram's hash, so that suffixes which may share windows come
   together), keeps one of equal ones, and sends front-coded runs: for each suffix the length of the prefix it shares
   with the one before, and the rest. Their number of buckets follows the bytes to sort, so a bucket's runs fit a task. They
   meet in a loser tree that holds, for every run, how much its head shares with the last output: the larger share wins
   without looking at a byte, and equal shares are compared only beyond the share.
4. Equal suffixes are repeated with all their windows. Different suffixes of one gram can share some: their windows are
   compared by (gram, window) hashes, 128 bits. Suffixes of a gram with more than `hot` anchors are dealt by their own
   hash instead of the gram's, and their windows are compared in a shuffle by window hash, so no group has to fit a task.
5. Repeated windows join back to the texts as byte ranges. A text that occurs twice is repeated as a whole.

Null text counts as empty, and texts under `length` bytes have no window. Repeated rows are occurrences of their own,
whether or not they share a doc_id. Texts are known by 64 bits; where 128 bits show that two share them, they get others.
Ties (equal hashes in a window) go to the first place, in every window alike. Columns other than doc_id and text are not
read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded, drop_dir, shared_dir, staged

LENGTH = 200
GRAM = 64
HOT = 2000
CHUNK = 1 << 20
RUN = 12 << 20
BUCKET = 16 << 20
BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of BASE and of its inverse, modulo 2**64; kept as far as they were ever needed."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def sums_of(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of the data follows."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)])))


def gram_hashes(data: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n bytes from each place on."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    sums = sums_of(data) if sums is None else sums
    return mixed((sums[n:] - sums[:-n]) * powers(len(data))[1][: len(data) - n + 1])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, text number, start and end of the suffix in the text, hash of the suffix) of every anchor. Together under 16 MB."""
    size = np.array([len(t) for t in texts], np.int64)
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
    starts, none = len(data) - length + 1, np.zeros(0, np.int64)
    if starts < 1:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    gram = min(GRAM, length)
    span = length - gram + 1
    sums = sums_of(data)
    h = gram_hashes(data, gram, sums)
    bits = max(24, int(len(h)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    key = np.full(-(-len(h) // span) * span, np.uint64(2**64 - 1))
    key[: len(h)] = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    rows = key.reshape(-1, span)
    head, tail = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[:starts], head[span - 1 : span - 1 + starts]) & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)[:starts]
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts) - 1
    d = doc[first]
    whole = first + length <= ends[d]
    first, last, d = first[whole], last[whole], d[whole]
    end = np.minimum(last, ends[d] - length) + length
    begin = ends[d] - size[d]
    content = mixed((sums[end] - sums[first]) * powers(len(data))[1][first]) + (end - first).astype(np.uint64)
    # Anchors have small hashes; mixed again they are spread evenly.
    return mixed(h[anchor[first]]), d, first - begin, end - begin, content


def repeats(texts: list[bytes], gram: np.ndarray, d: np.ndarray, start: np.ndarray, end: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes: (which stand for others that are equal, which have another standing for them)."""
    o = np.lexsort((content, gram))
    new = np.ones(len(o), bool)
    new[1:] = (gram[o][1:] != gram[o][:-1]) | (content[o][1:] != content[o][:-1])
    lead = o[new][np.cumsum(new) - 1] if len(o) else o
    stands, again = np.zeros(len(o), bool), np.zeros(len(o), bool)
    for k, j in zip(o[~new].tolist(), lead[~new].tolist(), strict=True):
        if texts[d[k]][start[k] : end[k]] == texts[d[j]][start[j] : end[j]]:
            stands[j] = again[k] = True
    return stands, again


def joined_ranges(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges by text; starts ascend within a text, texts ascend."""
    if not len(d):
        return d, start, end
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + d * far)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] + d[1:] * far > reach[:-1])
    at = np.flatnonzero(new)
    return d[at], start[at], reach[np.append(at[1:], len(d)) - 1] - d[at] * far


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


Entry = tuple[bytes, int, int, int]  # suffix headed by its gram's hash, text (or 0), first start, 1 if it is known to be repeated


def front_coded(entries: list[Entry]) -> bytes:
    """A sorted run."""
    shares, rests, last = [], [], b""
    for e in entries:
        k = shared(last, e[0])
        shares.append(k)
        rests.append(e[0][k:])
        last = e[0]
    sizes = np.array([len(r) for r in rests], np.uint32)
    return pickle.dumps((np.array(shares, np.uint32).tobytes(), sizes.tobytes(), b"".join(rests), np.array([e[1] for e in entries], np.int64).tobytes(), np.array([e[2] for e in entries], np.uint32).tobytes(), bytes(e[3] for e in entries)))


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(bytes shared with the entry before, entry)."""
    shares, sizes, rests, texts, firsts, known = pickle.loads(run)  # noqa: S301  written by front_coded
    at, last = 0, b""
    for share, size, text, first, k in zip(np.frombuffer(shares, np.uint32).tolist(), np.frombuffer(sizes, np.uint32).tolist(), np.frombuffer(texts, np.int64).tolist(), np.frombuffer(firsts, np.uint32).tolist(), known, strict=True):
        last = last[:share] + rests[at : at + size]
        at += size
        yield share, (last, text, first, k)


class LoserTree:
    """Merges sorted runs. Every head carries what it shares with the last output; a match compares bytes beyond that only."""

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.head: list[Entry | None] = [None] * self.size
        self.share = [0] * self.size
        self.lost = [-1] * self.size
        self.compared = 0
        for k, run in enumerate(runs):
            if x := next(run, None):
                self.head[k] = x[1]
        level = list(range(self.size))
        while len(level) > 1:
            up = []
            for i in range(0, len(level), 2):
                winner, loser = self._match(level[i], level[i + 1])
                self.lost[len(level) // 2 + i // 2] = loser
                up.append(winner)
            level = up
        self.best = level[0]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes what it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = self.share[a], self.share[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        k = shared(x[0], y[0], p)
        self.compared += k - p
        a_first = x[0][k:] <= y[0][k:] if k < min(len(x[0]), len(y[0])) else len(x[0]) <= len(y[0])
        winner, loser = (a, b) if a_first else (b, a)
        self.share[loser] = k
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        while (e := self.head[self.best]) is not None:
            k = self.best
            yield self.share[k], e
            x = next(self.runs[k], None)
            self.share[k], self.head[k] = x if x else (0, None)
            node = (self.size + k) >> 1
            while node:
                other = self.lost[node]
                winner, loser = self._match(k, other)
                self.lost[node] = loser
                k, node = winner, node >> 1
            self.best = k


def equal_groups(runs: list[bytes]) -> Iterator[tuple[bytes, list[Entry]]]:
    """The distinct suffixes of the runs in order, each with its entries."""
    held: list[Entry] = []
    for share, e in LoserTree([decoded(r) for r in runs]):
        if held and not (share == len(e[0]) == len(held[0][0])):
            yield held[0][0], held
            held = []
        held.append(e)
    if held:
        yield held[0][0], held


def windows_of(suffixes: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix number, offset) of every window; the hash covers the gram too. Suffixes are headed by 8 bytes."""
    bodies = [s[8:] for s in suffixes]
    n = np.array([len(b) - length + 1 for b in bodies], np.int64)
    at = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))[:-1]
    which = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    grams = np.frombuffer(b"".join(s[:8] for s in suffixes), ">u8").astype(np.uint64)
    h = gram_hashes(np.frombuffer(b"".join(bodies), np.uint8), length)
    return mixed(h[np.repeat(at, n) + offset] + grams[which] * SPREAD), which, offset


def ranges(which: np.ndarray, offset: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(suffix number, start, end) of the runs of consecutive windows; sorted input."""
    if len(which):
        new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1))))
        last = np.append(new[1:], len(which)) - 1
        yield from zip(which[new].tolist(), offset[new].tolist(), (offset[last] + length).tolist(), strict=True)


OUT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("known", pa.int32())])
OUT_SQL = "bucket int, blob binary, t long, start long, end long, known int"


def found_rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    t, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    n = len(t)
    return pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(t, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int32())], schema=OUT)


def sent_runs(entries: dict[bytes, list[tuple[int, int]]], known: set[bytes], hot: set[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """A task's repeated suffixes as found ranges, and its distinct ones as one run a bucket (hot ones in buckets of their own)."""
    found, by = [], {}
    for s in sorted(entries):
        places = entries[s]
        if len(places) > 1:
            found += [(t, a, a + len(s) - 8) for t, a in places]
        h = xxhash.xxh3_64_intdigest(s) if s[:8] in hot else int.from_bytes(s[:8], "big")
        by.setdefault((h * buckets >> 64) + buckets * (s[:8] in hot), []).append((s, *places[0], int(len(places) > 1 or s in known)))
    yield found_rows(found)
    keys = list(by)
    n = len(keys)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([front_coded(by[k]) for k in keys], pa.binary()), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.int32())], schema=OUT)


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """(t, base, piece): the texts (text, t) of `length` bytes or more in pieces; every window lies in one of them."""
    n, raw = F.octet_length("text"), F.col("text").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), n - length, F.lit(CHUNK)), lambda b: F.struct(b.alias("base"), F.substring(raw, b + 1, F.lit(CHUNK + length - 1)).alias("piece")))
    return docs.where(n >= length).select("t", F.explode(cut).alias("x")).select("t", "x.base", "x.piece")


def repeated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(t, start, end): byte ranges of the texts of hash t that consist of repeated windows; docs has (text, t)."""
    spark = docs.sparkSession
    home = shared_dir(spark)
    parts = pieces(docs, length)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "t", "base", "first", "end", "known"]
        seen: set[tuple[int, int]] = set()
        for batch in in_slices(batches):
            texts, ids, bases, size = [], [], [], 0
            for t, base, text in [*zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), (None, None, None)]:
                if t is not None:
                    if (t, base) in seen:
                        continue
                    seen.add((t, base))
                if texts and (t is None or size > CHUNK // 2):
                    g, d, a, b, content = anchors(texts, length)
                    stands, again = repeats(texts, g, d, a, b, content)
                    t_, base_ = np.array(ids, np.int64), np.array(bases, np.int32)
                    go, both = ~again, stands | again
                    rd, ra, rb = joined_ranges(d[both], a[both], b[both])
                    for gram, of, x, y, k in ((pa.array(g[go].view(np.int64)), d[go], a[go], b[go], stands[go]), (pa.nulls(len(rd), pa.int64()), rd, ra, rb, np.ones(len(rd), bool))):
                        yield pa.RecordBatch.from_arrays([gram, pa.array(t_[of]), pa.array(base_[of]), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(k)], names)
                    texts, ids, bases, size = [], [], [], 0
                if t is not None:
                    texts.append(text)
                    ids.append(t)
                    bases.append(base)
                    size += len(text)

    places = staged(parts.mapInArrow(sample, "gram long, t long, base int, first int, end int, known boolean"), f"{home}/anchors")
    again = places.where("gram is null").select("t", (F.col("base") + F.col("first")).cast("long").alias("start"), (F.col("base") + F.col("end")).cast("long").alias("end"))
    grams = staged(places.where("gram is not null").groupBy("gram").count().where("count > 1").select("gram", (F.col("count") > hot).alias("hot")), f"{home}/grams", "uncompressed")
    mine = places.join(grams, "gram").groupBy("t", "base").agg(F.sum(F.col("end") - F.col("first")).alias("n"), F.collect_set(F.struct("gram", "first", "end", "hot", "known")).alias("at"))
    mine = staged(mine, f"{home}/candidates")
    # A bucket holds about BUCKET bytes of suffixes, however many there are in all.
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (mine.agg(F.sum("n")).first()[0] or 0) // BUCKET + 1)
    drop_dir(spark, f"{home}/grams")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[bytes, list[tuple[int, int]]] = {}
        hots: set[bytes] = set()
        known: set[bytes] = set()
        size = 0
        for batch in in_slices(batches):
            at = batch.column(3)
            offsets = at.offsets.to_numpy() - at.offsets[0].as_py()
            gram, first, end, is_hot, is_known = (x.to_numpy(zero_copy_only=False) for x in at.flatten().flatten())
            heads = gram.astype(">i8").tobytes()
            first, end, is_hot, is_known = first.tolist(), end.tolist(), is_hot.tolist(), is_known.tolist()
            for row, (t, base, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                for k in range(offsets[row], offsets[row + 1]):
                    head = heads[8 * k : 8 * k + 8]
                    s = head + text[first[k] : end[k]]
                    if is_hot[k]:
                        hots.add(head)
                    if is_known[k]:
                        known.add(s)
                    if s in entries:
                        entries[s].append((t, base + first[k]))
                        size += 100
                    else:
                        entries[s] = [(t, base + first[k])]
                        size += len(s) + 100
                if size > RUN:
                    yield from sent_runs(entries, known, hots, buckets)
                    entries, known, hots, size = {}, set(), set(), 0
        if entries:
            yield from sent_runs(entries, known, hots, buckets)

    # Copies of a text are put together before they are shuffled.
    once = parts.groupBy("t", "base").agg(F.min("piece").alias("piece"))
    joined = once.join(mine, ["t", "base"]).select("t", "base", "piece", "at")
    runs = staged(joined.mapInArrow(sort, OUT_SQL), f"{home}/runs")
    drop_dir(spark, f"{home}/candidates")

    def solve(held: list[tuple[bytes, Entry, bool]]) -> Iterator[tuple[int, int, int]]:
        """Windows that different suffixes of a gram share. held: suffix, its entry, whether all its windows are repeated."""
        h, which, offset = windows_of([s for s, _, _ in held], length)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        known = np.array([k for _, _, k in held])
        more = (n[back] > 1) & ~known[which]
        for k, a, b in ranges(which[more], offset[more], length):
            e = held[k][1]
            yield e[1], e[2] + a, e[2] + b

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches):
            found, held, group, size, out = [], [], [], 0, []
            for s, entries in equal_groups(blobs):
                all_known = len(entries) > 1 or entries[0][3] == 1
                if all_known:
                    found += [(e[1], e[2], e[2] + len(s) - 8) for e in entries if not e[3]]
                if bucket >= buckets:
                    out.append((s, entries[0], all_known))
                    if len(out) >= 2_000:
                        yield hot_rows(out)
                        out = []
                    continue
                if group and group[0][0][:8] != s[:8]:
                    if len(group) > 1 and not all(k for _, _, k in group):
                        held += group
                        size += sum(len(x) for x, _, _ in group)
                    group = []
                    if size > CHUNK:
                        found += solve(held)
                        held, size = [], 0
                group.append((s, entries[0], all_known))
            if len(group) > 1 and not all(k for _, _, k in group):
                held += group
            if held:
                found += solve(held)
            yield found_rows(found)
            if out:
                yield hot_rows(out)

    def hot_rows(rows: list[tuple[bytes, Entry, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-2] * len(rows), pa.int32()), pa.array([s for s, _, _ in rows], pa.binary()), pa.array([e[1] for _, e, _ in rows], pa.int64()), pa.array([e[2] for _, e, _ in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([int(k) for _, _, k in rows], pa.int32())], schema=OUT)

    merged = staged(runs.where("bucket >= 0").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, OUT_SQL), f"{home}/merged")
    hot_windows = hot_ranges(merged.where("bucket = -2").select("blob", "t", "start", "known"), buckets, home, length)
    found = lambda x: x.where("bucket = -1").select("t", "start", "end")
    return again.union(found(runs)).union(found(merged)).union(hot_windows)


def hot_ranges(rows: DataFrame, buckets: int, home: str, length: int) -> DataFrame:
    """Windows of hot suffixes (blob, t, start, known) that occur twice, found in a shuffle by ranges of window hashes.

    Windows that a batch repeats are found there, as ranges; one of each goes on, marked, in a packed row per bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2000):
            h, which, offset = windows_of(batch.column(0).to_pylist(), length)
            t, start, known = (batch.column(c).to_numpy() for c in (1, 2, 3))
            _, one, group, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            twice = (n > 1) | (np.bincount(group, known[which]) > 0)
            done = twice[group] & (known[which] == 0)
            yield found_rows([(int(t[k]), int(start[k]) + x, int(start[k]) + y) for k, x, y in ranges(which[done], offset[done], length)])
            to = ((h[one] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending, as h[one] is
            cut = np.searchsorted(to, np.arange(buckets + 1))
            sent = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            packed = [pickle.dumps(tuple(x[cut[b] : cut[b + 1]] for x in (h[one], t[which[one]], start[which[one]] + offset[one], twice))) for b in sent]
            n = len(sent)
            yield pa.RecordBatch.from_arrays([pa.array(sent, pa.int32()), pa.array(packed, pa.binary()), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.int32())], schema=OUT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_bucket(batches):
            h, t, at, twice = (np.concatenate(x) for x in zip(*map(pickle.loads, blobs), strict=True))
            _, group, n = np.unique(h, return_inverse=True, return_counts=True)
            more = ((n > 1) | (np.bincount(group, twice) > 0))[group] & ~twice
            o = np.lexsort((at[more], t[more]))
            yield found_rows([(t_, x, y) for t_, x, y in ranges(t[more][o], at[more][o], length)])

    windows = staged(rows.mapInArrow(emit, OUT_SQL), f"{home}/windows")
    met = windows.where("bucket >= 0").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, OUT_SQL)
    return windows.where("bucket = -1").unionAll(met).select("t", "start", "end")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket, from sorted batches."""
    bucket, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket:
                if blobs:
                    yield bucket, blobs
                bucket, blobs = b, []
            blobs.append(blob)
    if blobs:
        yield bucket, blobs


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed byte ranges) and kept (the remaining bytes)."""
    spark = docs.sparkSession
    bounded(spark)
    home = shared_dir(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    # Two texts with one name of 64 bits are told apart by 128: all but one get another name.
    whole = F.unhex(F.md5(F.col("text").cast("binary")))
    clash = staged(own.select("t", whole.alias("m")).groupBy("t").agg(F.min("m").alias("l"), F.max("m").alias("u")).where("l <> u").select(F.col("t").alias("c"), "l"), f"{home}/clash")
    if not clash.isEmpty():
        own = own.join(clash, F.col("t") == F.col("c"), "left").select("doc_id", "text", F.when(F.col("l") != whole, F.xxhash64(whole)).otherwise(F.col("t")).alias("t"))
    twice = own.select("t", F.octet_length("text").alias("n")).groupBy("t").agg(F.count("*").alias("k"), F.max("n").alias("n")).where((F.col("k") > 1) & (F.col("n") >= length)).select("t", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    found = repeated(own.select("text", "t"), length, hot).union(twice)
    by_text = staged(found.groupBy(F.col("t").alias("u")).agg(F.collect_set(F.struct("start", "end")).alias("found")), f"{home}/found")
    span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n, gone, kept = [], [], []
            for text, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                s = spans([(x["start"], x["end"]) for x in found or ()])
                edge = [0, *[x for r in s for x in r], len(text)]
                n.append(len(text))
                gone.append([{"start": a, "end": b} for a, b in s])
                kept.append(b"".join(text[edge[k] : edge[k + 1]] for k in range(0, len(edge), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = own.join(by_text, F.col("t") == F.col("u"), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
