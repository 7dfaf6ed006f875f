"""N-gram Jaccard join: signature trees, met by dual traversal.

A document's set holds the 64-bit hashes of its distinct word shingles; documents with equal sets form a class, named by
128 bits, and only classes are joined. Two sets link when their overlap reaches num/den of their union.

1. Upper nodes. Linked sets differ in at most H elements, where H follows from the sizes. Hash-dealt into H + 1 + m parts,
   two linked sets agree in at least m + 1 parts, so they agree in a part with more than one element unless both have
   more than m weaker parts (then they go on to another dealing, at last with their weak parts). Each class is entered in
   the node of the signature of every strong part; sizes are taken in bands, and a class near the next band is dealt
   there too. Sets too small for that are entered by their prefix instead: linked ones share one of its elements. So all
   links lie within nodes, and the number of entries follows the size of the sets alone.
2. Entries meet first inside a task, so that a hot node costs a row a batch; a node is kept as a star around one class.
3. The stars' pairs are tested: on the classes' token bitmaps and sizes, which travel without texts, and then exactly.
   Components of these links settle all nodes whose classes they connect.
4. An open node is cut into leaves by size, label and salt, of bounded classes and bytes; a node of few classes is one
   leaf. Leaves have the OR of their bitmaps and the range of their sizes. Pairs of leaves meet by size range and are
   dropped when the largest overlap that bitmaps and sizes allow is too small, or when both hold one label; the dual
   traversal goes on inside the pairs that stay, down to classes. Only classes of a pair that still may link send their
   texts, one copy for each such pair of leaves, and are verified exactly.
5. Components of all verified links, over classes, give the components of documents.

Null and wordless texts have no set and link with nothing. Fewer words than a shingle make one shingle of them all. Long
texts are taken whole; leaves hold fewer of them. Rows that share a doc_id each count with their own text; the component
is named by its smallest doc_id (null where no row has one). Ties have no effect: links alone decide. Columns other than
doc_id and text are not read and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded, drop_dir, flat, row_name, shared_dir, staged
from .components import components

LEAF = 256
LEAF_TOKENS = 1 << 21
FAN = 8
FEW = 32
BAND = 1.4
SIZE_BAND = 1.05
SEEDS = 4
CHUNK = 3 << 20
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32 = np.uint64(29), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S32)) * A
    x = (x ^ (x >> S29)) * B
    return x ^ (x >> S32)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = mixed(s + h[j : len(h) - n + 1 + j])
    return np.unique(s)


def class_of(s: np.ndarray) -> bytes:
    """The name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each token, in words; two to four times as many bits as tokens."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    held = np.zeros(bits, np.uint8)
    held[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held).view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap of n words for the same tokens."""
    while len(words) > n:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


class Scheme:
    """What sets emit: by size band the parts of a dealing, or a prefix of token pairs where too few tokens are left to a part.

    A pair is two tokens that follow one another in a set's order. A token that the other set lacks breaks two pairs, one
    that it has besides breaks one; so sets of n and m tokens with overlap o share 3 o - n - m - 1 pairs or more, and an
    element of each one's least so-and-many. Where that can be less than one, single tokens take the place of pairs."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.low = [1]
        while self.low[-1] < most:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND) + 1))
        self.num, self.den = num, den
        parts, spare, some = [], [], []
        for low, up in zip(self.low, self.low[1:], strict=False):
            h = 2 * (up - 1) * (den - num) // (den + num)
            m, best = 1, (0, 0)
            while m <= h // 2:  # enough spare parts that few sets have more weak ones
                mean = low / (h + 1 + m)
                weak = (h + 1 + m) * np.exp(-mean) * (1 + mean)
                if m >= weak + 2 * np.sqrt(weak):
                    best = h + 1 + m, m
                    break
                m += 1 + m // 50
            some.append(h > 0)  # elsewhere only equal sets link
            parts.append(best[0] if low >= 4 * best[0] else 0)
            spare.append(best[1])
        self.some, self.parts, self.spare = some, np.array(parts), np.array(spare)
        least = max(1, -(-num // (den - num)))  # the smallest set that links with a larger one
        self.pairs = self.shared(least) >= 1

    def bands(self, size: int) -> list[int]:
        """The bands in which a set of this size meets others of its size or larger."""
        i = int(np.searchsorted(self.low, size, "right")) - 1
        both = [i, i + 1] if size * self.den >= self.num * self.low[i + 1] else [i]
        return [b for b in both if self.some[b]]

    def shared(self, size: int) -> int:
        """Pairs that a set has in common with any that it links with, at least."""
        both = size + -(-self.num * size // self.den)
        return -(-((2 * self.num - self.den) * both) // (self.num + self.den)) - 1

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """Elements of which linked sets share one."""
        if not self.pairs:
            return mixed(s[: len(s) - -(-self.num * len(s) // self.den) + 1] + A)
        pairs = mixed(mixed(s[:-1] + A) + s[1:])
        n = len(pairs) - self.shared(len(s)) + 1
        return np.partition(pairs, n - 1)[:n] if 0 < n < len(pairs) else pairs


def signatures(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) of what the sets emit."""
    jobs, out_sig, out_set = [], [], []
    for d, s in enumerate(sets):
        bands = scheme.bands(len(s)) if len(s) else []
        jobs += [(d, b) for b in bands if scheme.parts[b]]
        if any(not scheme.parts[b] for b in bands):
            out_sig.append(scheme.prefix(s))
            out_set.append(np.full(len(out_sig[-1]), d))
    for seed in range(SEEDS):
        if not jobs:
            break
        doc, band = np.array(jobs).T
        parts = scheme.parts[band]
        base = np.concatenate(([0], np.cumsum(parts)))
        n = np.array([len(sets[d]) for d in doc])
        tokens = mixed(np.concatenate([sets[d] for d in doc]) + np.uint64(seed + 1) * C)
        slot = ((tokens >> S32) * np.repeat(parts, n).astype(np.uint64) >> S32).astype(np.int64) + np.repeat(base[:-1], n)
        sums, held = np.zeros(base[-1], np.uint64), np.bincount(slot, minlength=base[-1])
        np.add.at(sums, slot, mixed(tokens + B))
        place = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        sig = mixed(mixed(sums + held.astype(np.uint64)) + np.repeat(band * SEEDS + seed, parts).astype(np.uint64) * C + place.astype(np.uint64) * A)
        weak = held <= 1
        bad = np.add.reduceat(weak, base[:-1]) > scheme.spare[band]
        take = ~weak | (np.repeat(bad, parts) & (seed == SEEDS - 1))
        out_sig.append(sig[take])
        out_set.append(np.repeat(doc, parts)[take])
        jobs = [j for j, x in zip(jobs, bad, strict=True) if x]
    return flat(out_sig, np.uint64), flat(out_set, np.int64)


def stars(sig: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signatures, their first set), and for each further set of a signature (signature, set, the first set)."""
    o = np.lexsort((name, sig))
    sig, name = sig[o], name[o]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    lead = name[first][np.cumsum(first) - 1] if len(sig) else name
    return sig[first], name[first], sig[~first], name[~first], lead[~first]


def in_chunks(texts: list[bytes | None]) -> Iterator[range]:
    """Ranges of texts of about CHUNK bytes."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size > CHUNK:
            yield range(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


class Tree:
    """A signature tree over bitmaps of one width: levels of nodes, from the sets themselves to the root."""

    def __init__(self, words: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((size, *words.T[:2]))
        words, size = words[self.order], size[self.order]
        level = (words, size, size, size - np.bitwise_count(words).sum(1).astype(np.int64))  # bitmap, least and largest size, tokens lost to shared bits
        self.levels = [level]
        while len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), FAN)
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)


def possible(p: tuple, q: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether nodes i of p and j of q may hold a linked pair."""
    low, high = p[1][i] + q[1][j], np.minimum(p[2][i], q[2][j])
    ok = (p[2][i] * den >= num * q[1][j]) & (q[2][j] * den >= num * p[1][i]) & (high * (den + num) >= num * low)
    at = np.flatnonzero(ok)
    step = max(1, (1 << 22) // p[0].shape[1])
    for k in range(0, len(at), step):
        part = at[k : k + step]
        both = np.bitwise_count(p[0][i[part]] & q[0][j[part]]).sum(1).astype(np.int64) + np.minimum(p[3][i[part]], q[3][j[part]])
        ok[part] = both * (den + num) >= num * low[part]
    return ok


def dual(x: Tree, y: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (by number) whose bitmaps and sizes allow a link; each pair once if x is y. Depth first, in bounded blocks."""
    todo = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        a, b, i, j = todo.pop()
        ok = possible(x.levels[a], y.levels[b], i, j, num, den)
        if x is y:
            ok &= (i < j) if a == 0 else (i <= j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if a == b == 0:
            yield x.order[i], y.order[j]
            continue
        a_, b_ = max(a - 1, 0), max(b - 1, 0)
        left = i[:, None] * FAN + np.arange(FAN) if a else i[:, None]
        right = j[:, None] * FAN + np.arange(FAN) if b else j[:, None]
        i2, j2 = np.repeat(left, right.shape[1], 1).ravel(), np.tile(right, left.shape[1]).ravel()
        real = (i2 < len(x.levels[a_][0])) & (j2 < len(y.levels[b_][0]))
        i2, j2 = i2[real], j2[real]
        todo += [(a_, b_, i2[k : k + (1 << 16)], j2[k : k + (1 << 16)]) for k in range(0, len(i2), 1 << 16)]


@lru_cache(FEW + 1)
def all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def near_pairs(maps: list[np.ndarray], sizes: list[int], sides: list[int], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (by number) whose bitmaps and sizes allow a link: among side 0, or between sides 0 and 1 where there is a side 1. A few sets need no tree."""
    if len(maps) <= FEW and not any(sides):
        width = min(map(len, maps))
        words, size = np.stack([folded(m, width) for m in maps]), np.array(sizes, np.int64)
        level = words, size, size, size - np.bitwise_count(words).sum(1).astype(np.int64)
        i, j = all_pairs(len(maps))
        ok = possible(level, level, i, j, num, den)
        yield i[ok], j[ok]
        return
    left, x, right, y = trees(maps, sizes, sides)
    for i, j in dual(x, y, num, den):
        yield left[i], right[j]


def trees(maps: list[np.ndarray], sizes: list[int], sides: list[int]) -> tuple[list[int], Tree, list[int], Tree]:
    """(numbers, tree) of side 0 and of side 1; the same tree twice where there is no side 1."""
    width = min(map(len, maps))
    words, size, side = np.stack([folded(m, width) for m in maps]), np.array(sizes, np.int64), np.array(sides)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    x = Tree(words[left], size[left])
    y = Tree(words[right], size[right]) if len(right) else x
    return left, x, right if len(right) else left, y


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[k] == a).sum())


def links(names: list[bytes], sides: list[int], labels: list[bytes], sets: list[np.ndarray], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """A spanning set of the links of one group, labels apart: among side 0, or between sides 0 and 1 where there is a side 1."""
    first: dict[bytes, int] = {}
    up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    out = []
    for i, j in near_pairs([bitmap(s) for s in sets], [len(s) for s in sets], sides, num, den):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb and overlap(sets[a], sets[b]) * (den + num) >= num * (len(sets[a]) + len(sets[b])):
                up[rb] = ra
                out.append((names[a], names[b]))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows whose first `keys` columns agree, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def classes(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, r (its name), n (set size), c (class), v (half of the class's name) and bits (its bitmap); null without a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # this task's classes: only the first row of a class carries the bitmap
        for batch in batches:
            n, c, bits = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingle_set(text, words)
                n.append(len(s))
                c.append(class_of(s) if len(s) else None)
                bits.append(bitmap(s).tobytes() if len(s) and c[-1] not in seen else None)
                seen.add(c[-1])
            v = [int.from_bytes(x[:8], "little", signed=True) if x else None for x in c]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(v, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "r", "n", "c", "v", "bits"])

    rows = docs.select("doc_id", "text", row_name(F.col("doc_id"), F.col("text")).alias("r"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, r binary, n long, c binary, v long, bits binary")


def entries(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(sig, v, lead): the stars of all nodes of two names or more; lead is another name of the node. Names have 64 bits here."""
    scheme = Scheme(num, den)
    names = ["key", "v", "sig", "lead"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # this task's classes: repeated texts emit nothing more
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for part in in_chunks(texts):
                sets, own = [], []
                for k in part:
                    s = shingle_set(texts[k], words)
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        sets.append(s)
                        own.append(c)
                v = np.frombuffer(b"".join(own), np.int64)[::2]
                sig, lead, more, a, b = stars(*signatures(sets, scheme))
                # A signature goes to its node once for the chunk; the chunk's other classes go beside, dealt by their own names.
                none, keys = pa.nulls(len(sig), pa.int64()), sig.view(np.int64)
                for cols in ((keys, v[lead], none, none), (v[a], v[a], more.view(np.int64), v[b])):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            beside = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            key, v, sig, lead = (x.fill_null(0).to_numpy() for x in batch.columns)
            k, c = key[~beside], v[~beside]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            to = c[first][np.cumsum(first) - 1] if len(k) else c.copy()
            if len(k) and last_key == k[0]:
                to[k == k[0]] = last
            if len(k):
                last_key, last = int(k[-1]), int(to[-1])
            other = c != to
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((sig[beside], k[other]), (v[beside], c[other]), (lead[beside], to[other]))], ["sig", "v", "lead"])

    rows = docs.select("text").mapInArrow(emit, ", ".join(f"{x} long" for x in names))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "sig long, v long, lead long")


def with_classes(star: DataFrame, met: DataFrame) -> DataFrame:
    """The stars (sig, c, lead) over classes. Two classes may have one name of 64 bits: both take its places, and they make a star of their own."""
    whole = star.join(met.select("v", "c"), "v").join(met.select(F.col("v").alias("lead"), F.col("c").alias("d")), "lead").select("sig", "c", F.col("d").alias("lead"))
    double = met.groupBy("v").agg(F.min("c").alias("l"), F.max("c").alias("u")).where("l <> u")
    return whole.where("c <> lead").union(met.join(double, "v").where("c <> l").select(F.col("v").alias("sig"), "c", F.col("l").alias("lead")))


def room(n: Column, leaf: int) -> Column:
    """How many classes of n tokens a group holds."""
    return F.greatest(F.lit(1), F.least(F.lit(leaf), F.floor(F.lit(LEAF_TOKENS) / n)))


def star_groups(star: DataFrame, slim: DataFrame, num: int, den: int, leaf: int) -> DataFrame:
    """(g, side, c, label): each class of a star whose bitmap allows a link with the lead, beside the lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(p), len(q))
                p, q = folded(p, w), folded(q, w)
                lost = min(n - int(np.bitwise_count(p).sum()), m - int(np.bitwise_count(q).sum()))
                keep.append((int(np.bitwise_count(p & q).sum()) + lost) * (den + num) >= num * (n + m))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 4])

    pairs = star.select("c", "lead").distinct()
    pairs = pairs.join(slim.select("c", "n", "bits"), "c").join(slim.select(F.col("c").alias("lead"), F.col("n").alias("m"), F.col("bits").alias("lead_bits")), "lead")
    pairs = pairs.where((F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)).select("c", "lead", "n", "bits", "m", "lead_bits")
    pairs = staged(pairs.mapInArrow(run, "c binary, lead binary, m long"), f"{shared_dir(star.sparkSession)}/pairs")
    counts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / room(F.max("m"), leaf)).alias("salts"))
    dealt = pairs.join(counts, "lead").select(F.xxhash64("lead", F.pmod(F.xxhash64("c"), F.col("salts"))).alias("g"), "c", "lead")
    return dealt.select("g", F.lit(1).alias("side"), "c", F.col("c").alias("label")).union(dealt.select("g", F.lit(0), "lead", "lead").distinct())


def open_nodes(star: DataFrame, slim: DataFrame, label: DataFrame, leaf: int) -> DataFrame:
    """(sig, node, own, c, label, n, bits): the leaves of all nodes that hold several labels and more than their star's pair.

    A node of few classes is one leaf, and its `node` is null. own is the label of another leaf that holds no other. Of
    nodes with the same classes one stands for all."""
    home = shared_dir(star.sparkSession)
    every = star.select("sig", "c").union(star.select("sig", "lead")).distinct()
    every = every.join(label.select(F.col("v").alias("c"), "label"), "c", "left").join(slim.select("c", "n"), "c")
    every = staged(every.select("sig", "c", F.coalesce("label", "c").alias("label"), "n"), f"{home}/every")
    held = every.groupBy("sig").agg(F.count("*").alias("k"), F.max("n").alias("most"), F.min("label").alias("l"), F.max("label").alias("u"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y"))
    still = held.where("k > 2 and l <> u").groupBy("k", "x", "y").agg(F.min("sig").alias("sig"), F.max("most").alias("most"))
    m = every.join(still.select("sig", (F.col("k") <= room(F.col("most"), leaf)).alias("whole")), "sig")
    m = staged(m.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(SIZE_BAND)))), f"{home}/open")
    large = m.where("not whole")
    sole = large.groupBy("sig", "label").agg(F.count("*").alias("of_label")).where(F.col("of_label") * 2 > leaf).select("sig", "label", F.col("label").alias("own"))
    large = large.join(sole, ["sig", "label"], "left")
    counts = large.groupBy("sig", "band", "own").agg(F.ceil(F.count("*") / room(F.max("n"), leaf)).alias("salts")).withColumnsRenamed({"sig": "s", "band": "b", "own": "o"})
    large = large.join(counts, (F.col("sig") == F.col("s")) & (F.col("band") == F.col("b")) & F.col("own").eqNullSafe(F.col("o")))
    salt = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("c")), F.col("salts"))
    large = large.select("sig", F.xxhash64("band", F.coalesce("own", F.lit(b"")), salt).alias("node"), "own", "c", "label")
    few = m.where("whole").select("sig", F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("own"), "c", "label")
    return few.union(large).join(slim.select("c", "n", "bits"), "c").select("sig", "node", "own", "c", "label", "n", "bits")


def upper(leaves: DataFrame) -> DataFrame:
    """(sig, node, own, low, high, lost, bits) of the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            maps = [np.frombuffer(r[4], np.uint64) for r in group]
            width = min(map(len, maps))
            maps = [folded(m, width) for m in maps]
            sizes = [r[3] for r in group]
            lost = max(n - int(np.bitwise_count(m).sum()) for n, m in zip(sizes, maps, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([group[0][0]], pa.int64()), pa.array([group[0][1]], pa.int64()), pa.array([group[0][2]], pa.binary()), pa.array([min(sizes)], pa.int64()), pa.array([max(sizes)], pa.int64()), pa.array([lost], pa.int64()), pa.array([np.bitwise_or.reduce(maps).tobytes()], pa.binary())], ["sig", "node", "own", "low", "high", "lost", "bits"])

    rows = leaves.where("node is not null").select("sig", "node", "own", "n", "bits").repartition("sig", "node").sortWithinPartitions("sig", "node")
    return rows.mapInArrow(run, "sig long, node long, own binary, low long, high long, lost long, bits binary")


def node_pairs(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, x, y): pairs of leaves of one node that may hold a link between two labels; x = y for a leaf by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for low, lost, a, b in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True):
                p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                w = min(len(p), len(q))
                # Where a bitmap is folded its classes lose more, at most as many as its size has beyond the bits.
                loss = lost if len(p) == len(q) else low
                keep.append((int(np.bitwise_count(folded(p, w) & folded(q, w)).sum()) + loss) * (den + num) >= num * low)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2])

    # Leaves hold one size band, so only those of bands within reach meet, whatever the number of leaves.
    reach = int(np.ceil(np.log(den / num) / np.log(SIZE_BAND))) + 1
    band = F.floor(F.log(F.col("low")) / F.log(F.lit(SIZE_BAND)))
    x, y = (nodes.select("sig", band.alias(f"band{s}"), *[F.col(k).alias(f"{k}{s}") for k in ("node", "own", "low", "high", "lost", "bits")]) for s in "12")
    x = x.withColumn("band2", F.explode(F.sequence(F.col("band1"), F.col("band1") + reach)))
    both = x.join(y, ["sig", "band2"]).where(((F.col("band1") < F.col("band2")) | (F.col("node1") < F.col("node2"))) & (F.col("high1") * den >= F.col("low2") * num) & (F.col("high2") * den >= F.col("low1") * num) & ~F.coalesce(F.col("own1") == F.col("own2"), F.lit(False)))
    far = both.select("sig", F.col("node1").alias("x"), F.col("node2").alias("y"), (F.col("low1") + F.col("low2")).alias("low"), F.least("lost1", "lost2").alias("lost"), "bits1", "bits2").mapInArrow(run, "sig long, x long, y long")
    return nodes.where("own is null").select("sig", F.col("node").alias("x"), F.col("node").alias("y")).union(far)


def leaf_groups(leaves: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(g, side, c, label): the classes that a dual traversal of two leaves leaves with a partner of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 1):
            sides, labels = [r[1] for r in group], [r[3] for r in group]
            if len(set(labels)) < 2 or group[0][6] and len(set(sides)) < 2:
                continue
            number: dict[bytes, int] = {}
            kind = np.array([number.setdefault(v, len(number)) for v in labels])
            need = np.zeros(len(group), bool)
            for i, j in near_pairs([np.frombuffer(r[5], np.uint64) for r in group], [r[4] for r in group], sides, num, den):
                ok = kind[i] != kind[j]
                need[i[ok]] = need[j[ok]] = True
            took = [r for r, ok in zip(group, need, strict=True) if ok]
            if took:
                g, side, c, label = zip(*[r[:4] for r in took], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(side, pa.int32()), pa.array(c, pa.binary()), pa.array(label, pa.binary())], ["g", "side", "c", "label"])

    g, two = F.xxhash64("sig", "x", "y").alias("g"), (F.col("x") != F.col("y")).alias("two")
    at = lambda end, side: leaves.withColumnRenamed("node", end).join(pairs, ["sig", end]).select(g, F.lit(side).alias("side"), "c", "label", "n", "bits", two)
    few = leaves.where("node is null").select(F.xxhash64("sig").alias("g"), F.lit(0).alias("side"), "c", "label", "n", "bits", F.lit(False).alias("two"))
    rows = few.union(at("x", 0)).union(at("y", 1).where("two"))
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, side int, c binary, label binary")


def verified(groups: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect all linked classes of each group (g, side, c, label); texts has (c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 1):
            found = links([r[2] for r in group], [r[1] for r in group], [r[3] for r in group], [shingle_set(r[4].encode(), words) for r in group], num, den) if len(group) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    rows = groups.join(texts, "c").select("g", "side", "c", "label", "text")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a binary, b binary")


def labelled(docs: DataFrame, words: int, num: int, den: int, leaf: int) -> DataFrame:
    """Per row: doc_id, r, n and label, which all rows of a component share; null without a set."""
    spark = docs.sparkSession
    bounded(spark)
    home = shared_dir(spark)
    docs = docs.select("doc_id", "text")
    own = staged(classes(docs, words), f"{home}/classes")
    # A class of several rows is known by one of them; its text is fetched once.
    first = staged(own.where("c is not null").groupBy("c").agg(F.min("r").alias("r"), F.max("v").alias("v"), F.max("n").alias("n"), F.max("bits").alias("bits")), f"{home}/first")
    star = staged(entries(docs, words, num, den), f"{home}/entries")
    several = first.groupBy("v").count().where("count > 1").select("v")
    names = star.select("v").union(star.select("lead")).union(several).distinct()
    slim = staged(first.join(names, "v", "left_semi"), f"{home}/met")
    star = staged(with_classes(star, slim), f"{home}/stars")
    rows = docs.select(row_name(F.col("doc_id"), F.col("text")).alias("r"), "text").groupBy("r").agg(F.min("text").alias("text"))
    texts = staged(rows.join(slim.select("r", "c"), "r").select("c", "text"), f"{home}/texts")
    near = staged(verified(star_groups(star, slim, num, den, leaf), texts, words, num, den), f"{home}/links")
    settled = components(near)
    leaves = staged(open_nodes(star, slim, settled, leaf), f"{home}/leaves")
    pairs = staged(node_pairs(staged(upper(leaves), f"{home}/nodes"), num, den), f"{home}/pairs")
    more = staged(verified(staged(leaf_groups(leaves, pairs, num, den), f"{home}/groups"), texts, words, num, den), f"{home}/more")
    last = components(near.union(more))
    out = staged(own.join(last.select(F.col("v").alias("c"), "label"), "c", "left").select("doc_id", "r", "n", F.coalesce("label", "c").alias("label")), f"{home}/labels")
    for name in ("classes", "first", "entries", "stars", "met", "texts", "links", "leaves", "nodes", "pairs", "groups", "more"):
        drop_dir(spark, f"{home}/{name}")
    return out


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, leaf: int = LEAF) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows = labelled(docs, words, num, den, leaf)
    least = staged(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), f"{shared_dir(docs.sparkSession)}/least")
    return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, leaf: int = LEAF) -> DataFrame:
    """One document of each component, with its columns as they were: that of the smallest doc_id, and of its texts in the component the one of least name.

    Rows that agree in doc_id and text are one document and leave one row (the least by a hash of all columns). Documents
    without a set are components of their own. Rows without doc_id stay, all of them."""
    rows = labelled(docs, words, num, den, leaf).where("doc_id is not null")
    best = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "r")).alias("least")).select("least.r")
    keep = staged(best.union(rows.where("label is null").select("r").distinct()).withColumnRenamed("r", "__jaccard_keep"), f"{shared_dir(docs.sparkSession)}/keep")
    has_id, cols = F.col("doc_id").isNotNull(), [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = docs.where(has_id).groupBy(row_name(F.col("doc_id"), F.col("text")).alias("__jaccard_keep")).agg(F.min_by(F.struct(*cols), F.xxhash64(*hashed)).alias("__jaccard_row"))
    return one.join(keep, "__jaccard_keep", "left_semi").select("__jaccard_row.*").union(docs.where(~has_id))
