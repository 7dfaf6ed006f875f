"""Line deduplication against levelled sorted runs of line hashes.

Documents arrive in batches. The store keeps runs: tables of (hash, owner) sorted by hash, whose hashes are disjoint.
A batch's distinct line hashes are merge-anti-joined with every run; what remains is new, belongs to the smallest doc_id
of the batch that holds it, and becomes a run of level 0. When a level holds `fanout` runs, they merge into one of the
next level, so a hash is rewritten once a level and the number of runs stays logarithmic in the number of batches.
A line is dropped in every document but its owner; all copies inside the owner stay.

A line's key is the line without blanks at its ends and with A-Z in lower case; keys under `min_chars` code points are
never dropped. Keys are held as 128-bit hashes. Null text counts as one empty line. Rows that share a doc_id count as
one document; a row without doc_id neither owns nor loses lines. Work is linear in a text's lines, however many of them
go. Other columns pass through; their names may be any but `into` and those that begin with it. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, LOWER, UPPER, drop_dir, shared_dir, staged

MIN_CHARS = 10
FANOUT = 3
BATCHES = 4
SAMPLE = 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def key_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key of a line, as hex; null for short keys."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.md5(key))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, t, place, h): the lines that count, of every document that has an id: hash of its text, number and hash of the line."""
    hashes = F.transform(lines_of(F.col("text")), lambda x: key_hash(x, min_chars))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("t"), F.posexplode(hashes).alias("place", "x"))
    return rows.where("x is not null").select("doc", "t", "place", F.unhex("x").alias("h"))


class LineRuns:
    """The store of line hashes; `path` lies in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout, self.levels, self.made = spark, path, fanout, [], 0

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def read(self, run: str) -> DataFrame:
        return self.spark.read.parquet(run)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.path}/run-{self.made}-level-{level}"
        self.made += 1
        # The shuffle before has put small partitions together; hashes don't compress.
        run.sortWithinPartitions("h").write.option("compression", "uncompressed").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def absorb(self, keys: DataFrame) -> None:
        """Take in a batch: (doc, h). Hashes that no run holds become a new run, owned by their smallest doc."""
        fresh = keys.groupBy("h").agg(F.min("doc").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(self.read(run).select("h").hint("merge"), "h", "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.union, map(self.read, merged)).repartition("h"), level + 1)
            for run in merged:
                drop_dir(self.spark, run)
            level += 1

    def lost(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (doc, h, ...) whose line belongs to another document; all documents have been absorbed."""
        owners = reduce(DataFrame.union, map(self.read, self.runs()))
        return keys.join(owners.hint("merge"), "h").where(F.col("doc") != F.col("owner"))


def batch_cuts(docs: DataFrame, batches: int) -> list:
    """Values of doc_id that part the documents into about equal batches."""
    if batches < 2:
        return []
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"):
        return sorted(set(docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []))
    some = sorted({r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLE).collect()})
    return sorted({some[k * len(some) // batches] for k in range(1, batches)}) if some else []


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, into: str = "line_dedup") -> DataFrame:
    """docs and a struct column `into`: text (the kept lines), n_lines, n_dropped.

    The table is taken as `batches` batches in the order of doc_id, so a line's owner is its smallest doc_id."""
    spark, home = docs.sparkSession, shared_dir(docs.sparkSession)
    cuts = batch_cuts(docs, batches)
    number = reduce(lambda c, x: c + F.when(F.col("doc") > F.lit(x), 1).otherwise(0), cuts, F.lit(0))
    keys = staged(keys_of(docs.select("doc_id", "text"), min_chars).withColumn("batch", number), f"{home}/keys")
    store = LineRuns(spark, f"{home}/runs", fanout)
    for k in range(len(cuts) + 1):
        store.absorb(keys.where(F.col("batch") == k).select("doc", "h"))
    lost = store.lost(keys).groupBy("doc", "t").agg(F.collect_set("place").alias(f"{into}_lost")).withColumnsRenamed({"doc": f"{into}_doc", "t": f"{into}_t"})
    lines, gone = lines_of(F.col("text")), F.col(f"{into}_lost")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # A transform over a one-element array binds the lines once.
    kept = F.array_join(F.transform(F.array(lines), lambda x: F.transform(left, lambda k: F.get(x, k)))[0], "\n")
    out = docs.join(lost, (docs["doc_id"] == F.col(f"{into}_doc")) & (F.xxhash64(docs["text"]) == F.col(f"{into}_t")), "left")
    count = lambda x: x.cast("long")
    struct = F.struct(F.when(gone.isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"), count(F.size(lines)).alias("n_lines"), count(F.when(gone.isNull(), 0).otherwise(F.size(gone))).alias("n_dropped"))
    return out.withColumn(into, struct).drop(f"{into}_doc", f"{into}_t", f"{into}_lost")


def line_dedup_table(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the text of the kept lines."""
    r = F.col("line_dedup")
    return dedup_lines(docs.select("doc_id", "text"), min_chars, batches).select("doc_id", r["n_lines"].alias("n_lines"), r["n_dropped"].alias("n_dropped"), r["text"].alias("text"))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs with the kept lines as text (and n_chars, where there is one, counted again). A document that loses lines and has no word left goes."""
    into = "__line_dedup"
    r, text = F.col(into), F.col(into)["text"]
    out = dedup_lines(docs, min_chars, batches, into=into).where((r["n_dropped"] == 0) | (F.length(F.translate(text, BLANK, "")) > 0))
    new = {"text": F.when(r["n_dropped"] == 0, F.col("text")).otherwise(text), "n_chars": F.when(r["n_dropped"] == 0, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
