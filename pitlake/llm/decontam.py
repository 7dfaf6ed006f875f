"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A window
is a set of word shingles that a document must hold completely, so its necessary prefix is one shingle: the rarest, by
the number of documents of the whole corpus that hold it. Documents meet windows on those prefix shingles only; the
position of the shingle in the window bounds where the window can start, its length where it can end, and the words
are then compared one by one. Shingles have `shingle` words, or all words of a shorter window.

The benchmark is the stated query set, taken in blocks of at most about `block` (window, item) pairs. Blocks follow one
another: one is collected, broadcast and held against every document, its hits are written, and it is given up before the
next, so that driver and workers never hold more than one. A single block needs no such table, and documents are not
shuffled then.

A null text has no words. Items without words have no windows; a null item_id counts as an empty one. Long texts are
searched whole. A tie between equally rare shingles goes to the smaller hash and changes no result. Repeated rows are
judged each by itself; columns other than doc_id and text (item_id and text) are not read, whatever their names; an empty
table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, UPPER, as_bytes, bounded, row_name, shared_dir, staged

WINDOW = 10
SHINGLE = 5
BLOCK = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the words of a window joined by blanks, and the item_id as a string."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    n = F.size("w")
    cut = F.when(n > window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.array_join(F.slice("w", i + 1, F.lit(window)), " "))).when(n > 0, F.array(F.array_join("w", " ")))
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).select("item", F.explode(cut).alias("window")).distinct()


class Block:
    """A block of windows, ready to be found in documents."""

    def __init__(self, rows: list[tuple[str, str]], shingle: int = SHINGLE):
        texts = sorted({w for w, _ in rows})
        at = {w: k for k, w in enumerate(texts)}
        split = [w.encode().split() for w in texts]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set(chain.from_iterable(split))), 1)}
        self.items: list[list[str]] = [[] for _ in texts]
        for w, item in rows:
            self.items[at[w]].append(item)
        self.size = np.array([len(x) for x in split], np.int64)
        self.words = np.zeros((len(texts), int(self.size.max(initial=0))), np.int64)
        for k, x in enumerate(split):
            self.words[k, : len(x)] = [self.vocabulary[w] for w in x]
        self.shingle = shingle
        self.lengths = sorted({int(min(shingle, n)) for n in self.size})
        # Every shingle of every window, by length: hash, window, place in the window.
        self.all = {}
        for t in self.lengths:
            parts = []
            for place in range(self.words.shape[1] - t + 1):
                k = np.flatnonzero((np.minimum(shingle, self.size) == t) & (place + t <= self.size))
                parts.append((hashed(self.words[k, place : place + t]), k, np.full(len(k), place)))
            self.all[t] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        self.known = {t: np.unique(self.all[t][0]) for t in self.lengths}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def number(self, t: int) -> int:
        """Where the shingles of length t begin when those of all lengths are numbered."""
        return sum(len(self.known[x]) for x in self.lengths if x < t)

    def order(self, counts: dict[int, int]) -> Block:
        """Choose each window's rarest shingle. counts: documents by the shingle's number; windows with a shingle that no document holds can't occur."""
        for t in self.lengths:
            h, w, place = self.all[t]
            df = np.array([counts.get(self.number(t) + k, 0) for k in range(len(self.known[t]))], np.int64)[np.searchsorted(self.known[t], h)]
            o = np.lexsort((place, h, df, w))
            first = np.ones(len(o), bool)
            first[1:] = w[o][1:] != w[o][:-1]
            o = o[first]
            o = o[df[o] > 0]
            o = o[np.argsort(h[o], kind="stable")]
            keys, start = np.unique(h[o], return_index=True)
            self.prefix[t] = keys, np.append(start, len(o)), w[o], place[o]
        self.all = {}
        return self


def hashed(words: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of word numbers."""
    h = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        h = (h + words[:, j].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def split_words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    words = [x.translate(ALNUM).split() if x else [] for x in texts]
    return words, np.fromiter(map(len, words), np.int64, len(words))


def numbered(words: list[list[bytes]], n: np.ndarray, block: Block) -> np.ndarray:
    """Word numbers of all texts in a row, 0 for words that no window has and after each text."""
    get = block.vocabulary.get
    return np.fromiter(chain.from_iterable(chain(map(get, w, repeat(0)), (0,)) for w in words), np.int64, int(n.sum()) + len(n))


def shingles_at(ids: np.ndarray, t: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers in known) of the shingles of length t that occur."""
    if len(ids) < t or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(ids > 0)))
    at = np.flatnonzero(run[t:] - run[:-t] == t)
    h = hashed(np.lib.stride_tricks.sliding_window_view(ids, t)[at])
    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[k] == h
    return at[hit], k[hit]


def count_shingles(texts: list[bytes | None], block: Block) -> np.ndarray:
    """Documents that hold each shingle of the block."""
    words, n = split_words(texts)
    ids, ends = numbered(words, n, block), np.cumsum(n + 1)
    out = np.zeros(sum(map(len, block.known.values())), np.int64)
    for t in block.lengths:
        at, k = shingles_at(ids, t, block.known[t])
        pairs = np.unique(np.searchsorted(ends, at, "right") * len(block.known[t]) + k)
        np.add.at(out, block.number(t) + pairs % len(block.known[t]), 1)
    return out


def find(texts: list[bytes | None], block: Block | None) -> list[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """Per text: words, words hit, hit runs (start and end in words), the items whose windows occur."""
    words, n = split_words(texts)
    ends = np.cumsum(n + 1)
    begins = ends - n - 1
    edge = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    if block is not None:
        ids = numbered(words, n, block)
        for t in block.lengths:
            keys, start, win, place = block.prefix[t]
            at, k = shingles_at(ids, t, keys)
            much = start[k + 1] - start[k]
            each = np.repeat(start[k], much) + np.arange(int(much.sum())) - np.repeat(np.cumsum(much) - much, much)
            w, s = win[each], np.repeat(at, much) - place[each]
            ok = (s >= 0) & (s + block.size[w] <= len(ids))
            w, s = w[ok], s[ok]
            for j in range(block.words.shape[1]):
                ok = (j >= block.size[w]) | (ids[np.minimum(s + j, len(ids) - 1)] == block.words[w, j])
                w, s = w[ok], s[ok]
            np.add.at(edge, s, 1)
            np.add.at(edge, s + block.size[w], -1)
            doc = np.searchsorted(ends, s, "right")
            for pair in np.unique(doc * len(block.size) + w).tolist():
                items[pair // len(block.size)].update(block.items[pair % len(block.size)])
    hit = np.cumsum(edge)[:-1] > 0
    change = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, a, b in zip(np.searchsorted(ends, first, "right").tolist(), first.tolist(), last.tolist(), strict=True):
        runs[d].append((a - int(begins[d]), b - int(begins[d])))
    return [(int(k), sum(b - a for a, b in r), r, sorted(i)) for k, r, i in zip(n, runs, items, strict=True)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


RUN = pa.struct({"start": pa.int64(), "end": pa.int64()})
RUN_SQL = "array<struct<start:long,end:long>>"


class Blocks:
    """The benchmark's windows in the shared folder, dealt into blocks."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block: int):
        spark = docs.sparkSession
        bounded(spark)
        self.docs, self.shingle, self.home = docs.select("doc_id", "text"), shingle, shared_dir(spark)
        self.pairs = staged(windows(benchmark, window), f"{self.home}/windows")
        self.n = -(-self.pairs.count() // block)

    def sent(self, k: int) -> Broadcast:
        """Block k, which knows its windows' rarest shingles over all documents."""
        sc = self.docs.sparkSession.sparkContext
        mine = self.pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(self.n)) == k)
        built = Block([(r[0], r[1]) for r in mine.select("window", "item").collect()], self.shingle)
        first = sc.broadcast(built)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(sum(map(len, first.value.known.values())), np.int64)
            for batch in batches:
                sums += count_shingles(as_bytes(batch.column(0)), first.value)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["shingle", "n"])

        rows = self.docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n"))
        counts = {r[0]: r[1] for r in rows.toLocalIterator()}  # at most the block's shingles
        first.destroy()
        return sc.broadcast(built.order(counts))

    def hits(self) -> DataFrame:
        """(r, spans, items) of the documents hit, by name; each block's are written before the next block comes."""
        named = self.docs.select("doc_id", "text", row_name(F.col("doc_id"), F.col("text")).alias("r"))
        for k in range(self.n):
            sent = self.sent(k)
            staged(scan(named, "r binary", sent).where("n_hit > 0").select("r", "spans", "items"), f"{self.home}/hits-{k}")
            sent.destroy()
        rows = self.docs.sparkSession.read.parquet(*[f"{self.home}/hits-{k}" for k in range(self.n)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans, items = [], []
                for all_runs, all_items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    spans.append([{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for some in all_runs for x in some])])
                    items.append(sorted({x for some in all_items for x in some}))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(RUN)), pa.array(items, pa.list_(pa.string()))], ["r", "spans", "items"])

        return staged(rows.groupBy("r").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items")).mapInArrow(run, f"r binary, spans {RUN_SQL}, items array<string>"), f"{self.home}/hits")


def scan(rows: DataFrame, name: str, sent: Broadcast | None) -> DataFrame:
    """rows is (doc_id, text, name) or, without a name, (doc_id, text). Per row: its first and last column, n_words, n_hit, spans, items."""
    one = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hit, spans, items = zip(*found, strict=True) if (found := find(as_bytes(batch.column(1)), sent.value if sent else None)) else ((), (), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(RUN)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[2:]], ["doc_id", "n_words", "n_hit", "spans", "items", *batch.schema.names[2:]])

    return rows.mapInArrow(run, f"doc_id {one}, n_words long, n_hit long, spans {RUN_SQL}, items array<string>" + (f", {name}" if name else ""))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (runs of hit words) and items."""
    blocks = Blocks(docs, benchmark, window, shingle, block)
    if blocks.n < 2:
        return scan(blocks.docs, "", blocks.sent(0) if blocks.n else None)
    hits = blocks.hits().select(F.col("r").alias("q"), F.col("spans").alias("s"), F.col("items").alias("i"))
    words = scan(blocks.docs.select("doc_id", "text", row_name(F.col("doc_id"), F.col("text")).alias("r")), "r binary", None)
    n_hit = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return words.join(hits, F.col("r") == F.col("q"), "left").select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns as they were."""
    blocks = Blocks(docs, benchmark, window, shingle, block)
    if blocks.n == 0:
        return docs
    if blocks.n > 1:
        hits = blocks.hits().select(F.col("r").alias("__decontam_r"))
        return docs.join(hits, row_name(F.col("doc_id"), F.col("text")) == F.col("__decontam_r"), "left_anti")
    at, sent = docs.columns.index("text"), blocks.sent(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x[1] == 0 for x in find(as_bytes(batch.column(at)), sent.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
