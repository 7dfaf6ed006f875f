"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models are bigram chains over [A-Za-z0-9+/_=-]. One learns from labelled random strings (what the base patterns
capture), the other from labelled ordinary identifiers (the other long words), both in a bounded sample: the `sample`
documents of least hash of (doc_id, text), half of them such as may hold a base match, of each at most `SAMPLE_CHARS`
characters. A chain backs off to its single characters (with weight `BACK`), and these to uniform ones (with `PRIOR`). A
run of at least `min_chars` such characters outside the base spans is a secret of kind `random` when it has a digit and a
letter or sign, and its log-likelihood ratio exceeds `margin`, both in all and per character; a ratio that only equals it
does not.

A null text counts as empty. Spans are code points, end exclusive. Time is linear in a text, however long and however
full of matches. Repeated rows are judged each by itself; other columns are not read, whatever their names. An empty
table gives an empty result; without samples the models are uniform and find nothing beyond the base.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded

# The base patterns and the least length of what must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CODE = np.full(128, len(CHARS), np.int64)
CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
IS_HEX = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
IS_RUN = bytes(120 if chr(b) in CHARS else 32 for b in range(256))

SAMPLE = 1000
SAMPLE_CHARS = 1 << 16
WIDE = 64  # so many times as many rows are looked through for those that may hold a match
MIN_CHARS = 20
PRIOR = 0.5
BACK = 8.0
MARGIN = (12.0, 0.4)

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, raw: bytes) -> list[Span]:
    """Matches of the base patterns that are long enough. raw: the text in UTF-8; it rules most texts out at once."""
    out: list[Span] = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(IS_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


def bigrams(strings: list[str]) -> np.ndarray:
    n = np.zeros((len(CHARS) + 1, len(CHARS) + 1))
    for s in strings:
        codes = np.concatenate(([len(CHARS)], CODE[np.frombuffer(s.encode("ascii"), np.uint8)]))
        np.add.at(n, (codes[:-1], codes[1:]), 1)
    return n


def train(random: list[str], ordinary: list[str]) -> np.ndarray:
    """Log-likelihood ratios of a character after another (the last index: the beginning)."""
    if not random or not ordinary:
        return np.zeros((len(CHARS) + 1, len(CHARS) + 1))
    logs = []
    for strings in (random, ordinary):
        n = bigrams(strings)
        one = n.sum(0) + PRIOR
        n += BACK * one / one.sum()
        logs.append(np.log(n / n.sum(1, keepdims=True)))
    return logs[0] - logs[1]


def outside(text: str, spans: list[Span], least: int) -> Iterator[re.Match]:
    """Runs of `least` characters or more that touch no span; spans are sorted."""
    k, upto = 0, -1
    for m in RUN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            upto = max(upto, spans[k][2])
            k += 1
        if m.end() - m.start() >= least and upto <= m.start():
            yield m


def labelled(rows: list[str]) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers) of sampled texts, labelled by the base patterns."""
    random, ordinary = [], []
    for text in rows:
        at = base_spans(text, text.encode())
        for start, kind, end in at:
            value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
            random += RUN.findall(value)
        ordinary += [m[0] for m in outside(text, at, 4)]
    return random, ordinary


def learn(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Train on the `sample` documents of least hashes: half of them such as may hold a base match, half others.

    A bound on the hash, from the number of rows, lets some WIDE * sample rows through; only these are searched. Their
    hashes alone are ranked; then the texts of the first are fetched, at most sample * SAMPLE_CHARS characters."""
    may = F.col("text").rlike("(?i)password|passwd|secret|token|api_?key|AKIA")
    bound = int(min(1.0, WIDE * sample / max(1, docs.count())) * (1 << 40))
    rows = docs.select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place")).where(F.col("text").isNotNull() & (F.col("place") < bound))
    first = F.row_number().over(Window.partitionBy("may").orderBy("place"))
    ranked = rows.select("place", may.alias("may")).distinct().withColumn("rank", first).where(F.col("rank") <= sample // 2)
    places = [r[0] for r in ranked.select("place").collect()]
    taken = rows.where(F.col("place").isin(places)).groupBy("place").agg(F.min("text").alias("text")).orderBy("place").select("text").collect() if places else []
    return train(*labelled([r[0] for r in taken]))


def all_spans(text: str | None, ratio: np.ndarray, min_chars: int = MIN_CHARS, margin: tuple[float, float] = MARGIN) -> list[Span]:
    """Base spans and those that the models add, by start, then kind."""
    if not text:
        return []
    raw = text.encode()
    out = base_spans(text, raw)
    if b"x" * min_chars not in raw.translate(IS_RUN):
        return out
    more = []
    for m in outside(text, out, min_chars):
        if any(map(str.isdigit, m[0])) and not m[0].isdigit():
            codes = np.concatenate(([len(CHARS)], CODE[np.frombuffer(m[0].encode("ascii"), np.uint8)]))
            score = float(ratio[codes[:-1], codes[1:]].sum())
            if score > margin[0] and score > margin[1] * len(m[0]):
                more.append((m.start(), 3, m.end()))
    return sorted(out + more)


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, min_chars: int = MIN_CHARS, margin: tuple[float, float] = MARGIN) -> DataFrame:
    """Per document: doc_id and spans, an array of (kind, start, end)."""
    bounded(docs.sparkSession)
    ratio = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t, ratio.value, min_chars, margin)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()})))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
