"""Quality rules whose thresholds follow the data, in DataFrame operations only.

Each document gets integer metrics. A mergeable quantile sketch of every metric is kept per (lang, source): a histogram
whose buckets grow geometrically (exact below 64, then 32 buckets for each doubling, so a quantile is off by 1/32 at
most). Sketches are plain counts: partial aggregation builds them, addition merges them, and the order of rows cannot
change them. The sketch of a language is the sum of its sources', the corpus sketch the sum of all. Of each metric an
upper quantile is trusted (and of some a lower one); a group's fence lies `spread` times as far beyond that quantile as
the quantile lies from the median. No threshold is fixed: where quantile and median agree, the step of the measure takes
the distance's place, which is what one more occurrence makes in that very document. A group of fewer than `min_group`
documents uses its language's quantiles, and a small language the corpus's. The fences join back to the documents, which
stay when every metric lies within or on them.

Null text counts as empty (no words: fails the base rules). Null lang or source form groups of their own. Long texts are
measured whole. Repeated rows count each. Columns other than text, lang and source are not read; those of docs may have
any name that does not begin with __quality. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, shared_dir, staged

# The base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT = 30

#: Metric -> the lower and upper quantile that are trusted, in hundredths, and the count that it is a share of. In thousandths.
METRICS = {
    "word_length": (10, 90, "n_words"),
    "symbols": (None, 90, "n_words"),
    "dup_lines": (None, 99, "n_lines"),
    "repeats": (None, 99, "n_words"),
    "exclaims": (None, 90, "n_words"),
}
SPREAD = 2.5
MIN_GROUP = 200
BITS = 6  # values under 2**BITS have a bucket each


def count_of(text: Column, chars: str) -> Column:
    """How often any of the (one-byte) characters occurs: one fast search each, no table look-up for every character."""
    n = F.lit(0).cast("long")
    for c in chars:
        n = n + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return n


def base_metrics(text: Column) -> Column:
    """Struct of the counts that the base rules and the fences need."""
    body = F.coalesce(text, F.lit(""))
    plain = body
    for c in BLANK[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(plain, " ", -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    return F.struct(
        words.alias("words"),
        (F.length(body) - count_of(body, BLANK)).alias("word_chars"),
        count_of(body, SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        count_of(body, "!?").alias("n_exclaims"),
    )


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that occur at least twice in the array, the first occurrence included.

    Most texts have no such window: their windows' hashes are all distinct. Otherwise the (hash, position) pairs are
    sorted; equal neighbours mark repeated windows, and a repeated window adds what it covers beyond the one before."""
    n = F.size(words)
    each = lambda x: F.transform(x, lambda w: F.xxhash64(w))
    hashes = lambda x: F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(F.slice(x, i + 1, F.lit(window))))
    twice = lambda s: F.sort_array(F.filter(
        F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
        lambda x: x.isNotNull(),
    ))
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    # A transform over a one-element array binds an intermediate once; a plain expression would be evaluated at each use.
    once = lambda x, f: F.transform(F.array(x), f)[0]
    found = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: once(twice(s), covered)))
    return F.when(n > window, once(each(words), lambda w: once(hashes(w), found))).otherwise(F.lit(0).cast("long"))


def held(x: Column) -> Column:
    """x, which is dear to compute. Spark copies no expression that isn't deterministic into its uses; this one's test always holds."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def with_metrics(docs: DataFrame, into: str) -> DataFrame:
    """docs and a struct column `into` with all counts, the base verdict and the judged metrics."""
    a = docs.withColumn(into, held(base_metrics(F.col("text"))))
    m = F.col(into)
    a = a.withColumn(into, held(F.struct(F.size(m["words"]).cast("long").alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), F.size(m["lines"]).cast("long").alias("n_lines"), (F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("long").alias("n_dup_lines"), m["n_exclaims"].alias("n_exclaims"), repeat_words(m["words"]).alias("n_repeat_words"))))
    share = lambda x, of: F.when(of > 0, F.floor(x * 1000 / F.when(of > 0, of))).otherwise(0).cast("long")
    return a.withColumn(
        into,
        held(F.struct(
            m["n_words"].alias("n_words"), m["n_lines"].alias("n_lines"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
            ((m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT)).alias("base_failed"),
            share(m["word_chars"], m["n_words"]).alias("word_length"), share(m["n_symbols"], m["n_words"]).alias("symbols"), share(m["n_dup_lines"], m["n_lines"]).alias("dup_lines"),
            share(m["n_repeat_words"], m["n_words"]).alias("repeats"), share(m["n_exclaims"], m["n_words"]).alias("exclaims"),
        )),
    )


def bucket(v: Column) -> Column:
    """The bucket of a value >= 0: itself below 64, then 32 buckets for each doubling."""
    shift = F.length(F.bin(v)) - BITS
    half = 1 << (BITS - 1)
    return F.when(v < 2 * half, v).otherwise(F.floor(v / F.pow(F.lit(2.0), shift)).cast("long") + shift.cast("long") * half)


def bucket_top(b: Column) -> Column:
    """The largest value in a bucket."""
    half = 1 << (BITS - 1)
    shift = F.floor(b / half) - 1
    return F.when(b < 2 * half, b).otherwise((b - shift * half + 1) * F.pow(F.lit(2.0), shift).cast("long") - 1).cast("long")


def sketches(metrics: DataFrame, m: str = "m") -> DataFrame:
    """(lang, source, metric, bucket, n) of documents that pass the base rules."""
    long = metrics.where(~F.col(m)["base_failed"]).select(
        F.col("lang").alias("lang"), F.col("source").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(m)[k]).alias("bucket")) for k in METRICS])).alias("x"),
    )
    return long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) that the sketch holds: `q`, a map from metric to its trusted quantiles and the median (low, middle, high)."""

    def quantiles(of: DataFrame, keys: list[str], tag: str) -> DataFrame:
        by = Window.partitionBy(*keys, "metric")
        run = of.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
        share = lambda end: F.create_map(*[F.lit(x) for k, v in METRICS.items() for x in (k, v[end] or 0)])[F.col("metric")]
        at = lambda k: bucket_top(F.min(F.when(F.col("upto") * 100 >= F.col("all") * k, F.col("bucket"))))
        return run.groupBy(*keys, "metric").agg(F.max("all").alias(f"n{tag}"), F.struct(at(share(0)).alias("low"), at(F.lit(50)).alias("middle"), at(share(1)).alias("high")).alias(f"q{tag}"))

    total = lambda *keys: sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    own, lang, corpus = quantiles(sketch, ["lang", "source"], "0"), quantiles(total("lang"), ["lang"], "1"), quantiles(total(), [], "2")
    lang = lang.select(F.col("lang").alias("lang_"), F.col("metric").alias("metric_"), "n1", "q1")
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("metric") == F.col("metric_")), "left").join(corpus, "metric", "left")
    pick = F.when(F.col("n0") >= min_group, F.col("q0")).when(F.col("n1") >= min_group, F.col("q1")).otherwise(F.col("q2"))
    return both.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", pick.alias("q")))).alias("q"))


def judged(metrics: DataFrame, fence: DataFrame, m: str = "m", into: str = "kept", spread: float = SPREAD) -> DataFrame:
    """metrics and a boolean column `into`."""
    f = fence.select(F.col("lang").alias(f"{into}_lang"), F.col("source").alias(f"{into}_source"), F.col("q").alias(f"{into}_q"))
    joined = metrics.join(f, F.col("lang").eqNullSafe(F.col(f"{into}_lang")) & F.col("source").eqNullSafe(F.col(f"{into}_source")), "left")
    inside = F.lit(True)
    for k, (low, _, of) in METRICS.items():
        v, q, step = F.col(m)[k], F.col(f"{into}_q")[k], 1000 / F.greatest(F.col(m)[of], F.lit(1))
        inside = inside & F.coalesce(v <= q["high"] + spread * F.greatest(q["high"] - q["middle"], step), F.lit(True))
        if low is not None:
            inside = inside & F.coalesce(v >= q["low"] - spread * F.greatest(q["middle"] - q["low"], step), F.lit(True))
    return joined.withColumn(into, ~F.col(m)["base_failed"] & inside).drop(f"{into}_lang", f"{into}_source", f"{into}_q")


def quality_table(docs: DataFrame, spread: float = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, the judged metrics and kept.

    The counts are written once, without texts, to the shared folder; sketches and verdicts both read them there."""
    spark = docs.sparkSession
    slim = staged(with_metrics(docs.select("doc_id", "text", "lang", "source"), "m").drop("text"), f"{shared_dir(spark)}/metrics")
    fence = staged(fences(sketches(slim), min_group), f"{shared_dir(spark)}/fences")
    out = judged(slim, fence, spread=spread)
    return out.select("doc_id", *[F.col("m")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *METRICS)], "kept")


def quality_filter(docs: DataFrame, spread: float = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that pass, with their columns as they were.

    Those that pass the base rules are written once with their metrics; the sketches read the metrics alone."""
    m, keep = "__quality_metrics", "__quality_kept"
    spark = docs.sparkSession
    passed = staged(with_metrics(docs, m).where(~F.col(m)["base_failed"]), f"{shared_dir(spark)}/measured")
    # Written, the fences have a size that Spark knows when it chooses the join: a few rows are sent round, and no text moves.
    fence = staged(fences(sketches(passed.select("lang", "source", m), m), min_group), f"{shared_dir(spark)}/fences")
    return judged(passed, fence, m, keep, spread).where(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])
