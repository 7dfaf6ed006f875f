"""Language identification by compression.

Every learned language has a raw-content zstandard dictionary: training texts in the order of a hash of their rows,
without repeats, up to `dict_bytes`. A text is compressed whole with each dictionary; the language whose dictionary
makes it smallest is predicted (both in lower case), and the prediction is rejected when the runner-up comes within `margin` of it.

Only rows chosen for training give texts to dictionaries: of each of the `langs` most frequent languages, the `sample`
rows of least hash of (doc_id, text), rows that agree in both once; texts longer than `dict_bytes` come after all others
and give that much. The prediction sees the text alone. A text that is null or has no letter (Unicode category L) is
`und`. Ties go to the first name. Long texts are compressed whole; repeated rows are judged each by itself; other
columns are not read, whatever their names; an empty table gives an empty result, and without training rows every text
is `und`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded

SAMPLE = 300
DICT_BYTES = 96 << 10
LEVEL = 9
MARGIN = 0.004
LANGS = 1000
LETTER = regex.compile(r"\p{L}")


def in_training(doc_id: Column) -> Column:
    """Whether a document may be learned from: the crc32 of its id as text leaves another remainder than 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def sampled(docs: DataFrame, sample: int = SAMPLE, dict_bytes: int = DICT_BYTES, langs: int = LANGS) -> dict[str, bytes]:
    """Raw dictionary content by language, from the training rows of the smallest hashes.

    The rows of each language are counted over all documents; a bound on the hash lets about four times `sample` through,
    and of these the first `sample` are taken, in each task already. At most langs * sample * dict_bytes reach the driver."""
    rows = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()}
    if not counts:
        return {}
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 4 * sample / n) * (1 << 40)))])
    long = F.octet_length("text") > dict_bytes
    few = rows.where(F.col("place") < bound[F.col("lang")]).groupBy("lang", long.alias("long"), "place").agg(F.min(F.left("text", F.lit(dict_bytes))).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("long", "place"))
    taken = few.withColumn("rank", first).where(F.col("rank") <= sample).orderBy("lang", "rank").select("lang", "text").collect()
    out = {}
    for lang in sorted(counts):
        texts, size = {}, 0
        for r in taken:
            raw = r["text"].lower().encode()[:dict_bytes] if r["lang"] == lang else b""
            if raw and raw not in texts and (not texts or size + len(raw) < dict_bytes):
                texts[raw] = True
                size += len(raw) + 1
        if texts:
            out[lang] = b"\n".join(reversed(texts))
    return out


class Classifier:
    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(contents)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, strategy=zstandard.STRATEGY_LAZY2, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, raw: bytes) -> list[int]:
        return [len(c.compress(raw)) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is the language's share when a byte more halves a language's weight."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text.lower().encode())
        best = min(sizes)
        rest = sorted(sizes)[1:]
        return self.langs[sizes.index(best)], 1 / sum(math.pow(2, max(best - s, -60)) for s in sizes), (rest[0] - best) / best if rest else 1.0


def identify(docs: DataFrame, contents: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, lang_best, score, margin and lang, which is null where the margin is too narrow."""
    bounded(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value, level)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[0] if x[2] >= margin else None for x in found], pa.string())], ["doc_id", "lang_best", "score", "margin", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_best string, score double, margin double, lang string")
