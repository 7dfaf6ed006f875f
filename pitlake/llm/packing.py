"""Best-fit packing of token sequences, online and in bounded space.

Each task tokenizes its documents, ends each with `end_id`, cuts those beyond the capacity and places the pieces into at
most `open_bins` open sequences. The open sequences are kept by their free space: a bitset has a bit for every amount
of free space that some open sequence has, so the best fit for a piece is the lowest set bit at or above its length, and
the fullest sequence, which is closed when there are too many, is the lowest set bit of all. Pieces of one Arrow batch
are placed longest first. Tasks pack on their own: nothing is shuffled, and a task that is run again gives the same
sequences under the same numbers.

A null text counts as empty: its document is the end token alone. A long text is cut into pieces, all of which are
packed. Ties: of sequences with the same free space the one that got it last takes the piece, and pieces of one length
follow the order of their rows. Repeated rows are packed each. Columns other than doc_id and text are not read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded

CAPACITY = 1024
END = 2
OPEN_BINS = 4096
#: Beyond these code points the libraries' Unicode tables may differ; such texts go through `tokenizers` itself.
PLAIN = re.compile(r"[^\x00-ɏ‐-‧]")


class Packer:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.most, self.made, self.open = capacity, open_bins, first, 0
        self.free = 0  # bit f: an open sequence has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, f: int) -> int:
        bins = self.by_free[f]
        at = bins.pop()
        if not bins:
            self.free ^= 1 << f
        return at

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            at = self._take(f)
        else:
            f, at = self.capacity, self.made
            self.made += 1
            self.open += 1
        rest = f - length
        if rest:
            self.by_free[rest].append(at)
            self.free |= 1 << rest
            if self.open > self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return at, self.capacity - f


class Tokens:
    """Token ids as `tokenizers` gives them for a byte-level BPE file, special tokens' strings included.

    Texts in common alphabets go through the same vocabulary in tiktoken, which is several times as fast."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self.slow, self.fast = path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library().get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def library(self):  # noqa: ANN201
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not PLAIN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library().encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def tokens(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Tokens:
    return Tokens(path, ranks_path, pattern)


def default_tokenizer() -> tuple[str, str, str]:
    """Paths of the public byte-level BPE: for `tokenizers`, the same ranks for tiktoken, and the pattern of both."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pack(docs: DataFrame, tokenizer: tuple[str, ...] | None = None, capacity: int = CAPACITY, end_id: int = END, open_bins: int = OPEN_BINS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    bounded(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(*tokenizer).ids
        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() << 40)
        last = np.array([end_id], np.uint32)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                all_ids = [np.concatenate((encode(t), last)).astype("<u4") if t else last.astype("<u4") for t in batch.column(1).to_pylist()]
                pieces = [(row, p, s, n) for row, ids in enumerate(all_ids) for p, (s, n) in enumerate(cuts(len(ids), capacity))]
                places = {x[:2]: packer.place(x[3]) for x in sorted(pieces, key=lambda x: -x[3])}
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([x[0] for x in pieces], pa.int32())),
                    pa.array([x[1] for x in pieces], pa.int32()), pa.array([x[2] for x in pieces], pa.int64()), pa.array([x[3] for x in pieces], pa.int64()),
                    pa.array([all_ids[row][s : s + n].tobytes() for row, _, s, n in pieces], pa.binary()),
                    pa.array([places[x[:2]][0] for x in pieces], pa.int64()), pa.array([places[x[:2]][1] for x in pieces], pa.int64()),
                ], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")


