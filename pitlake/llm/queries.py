"""The queries of this subpackage: op name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, in_training, sampled

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, sampled(docs))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "margin", F.col("lang").isNull().alias("rejected"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_table

    return quality_table(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(line(of("assign", "access", "hex")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_dedup_table

    return line_dedup_table(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents"))
    names = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    base, more = F.transform("phrases", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    starts = F.transform("phrases", lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["covered"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(base, more).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import dedup_substrings

    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_quality_rules, op4_secret_scan, op5_packing, op6_line_dedup, op7_warc, op8_license_scan, op9_decontamination, op10_suffix_dedup)}

ORACLES: dict[str, str] = {
    "op2_jaccard_join": r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as materialized (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) s from w where len(w) > 0),
tokens as materialized (select doc_id, len(s) n, unnest(s) g from sets),
common as (select a.doc_id a, b.doc_id b, any_value(a.n) n, any_value(b.n) m, count(*) k from tokens a join tokens b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as materialized (select a, b from common where 100 * k >= 90 * (n + m - k)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a doc_id, min(b) least from reach group by a)
select w.doc_id, coalesce(len(s), 0)::bigint n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) component_id
from w left join sets using (doc_id) left join least using (doc_id)""",
    "op3_quality_rules": r"""
with w as materialized (select row_number() over () r, doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
win as materialized (select r, i, array_to_string(w[i:i + 7], ' ') g from (select r, w, unnest(range(1, len(w) - 6)) i from w where len(w) >= 8)),
rep as (select r, count(distinct p) n from (select r, unnest(range(i, i + 8)) p from win join (select r, g from win group by r, g having count(*) > 1) using (r, g)) group by r),
counts as (select w.r, doc_id, lang, source, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, len(regexp_extract_all(t, '[!?]')) n_exclaims from w left join rep using (r)),
m as materialized (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from counts),
measured as materialized (select r, lang, source, unnest([
  {'metric': 'word_length', 'v': 1000 * word_chars // greatest(n_words, 1), 'of': n_words}, {'metric': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1), 'of': n_words},
  {'metric': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 'of': n_lines}, {'metric': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 'of': n_words},
  {'metric': 'exclaims', 'v': 1000 * n_exclaims // greatest(n_words, 1), 'of': n_words}], recursive := true) from m where not base_failed),
trusted(metric, low, high) as (values ('word_length', 10, 90), ('symbols', null, 90), ('dup_lines', null, 99), ('repeats', null, 99), ('exclaims', null, 90)),
sketch as materialized (select coalesce(lang, chr(1)) lang, coalesce(source, chr(1)) source, metric, case when v < 64 then v else (v >> (length(bin(v)) - 6)) + 32 * (length(bin(v)) - 6) end bucket, count(*) n from measured group by all),
grouped as (select 0 level, lang, source, metric, bucket, n from sketch union all select 1, lang, '', metric, bucket, sum(n) from sketch group by all union all select 2, '', '', metric, bucket, sum(n) from sketch group by all),
upto as (select *, sum(n) over (partition by level, lang, source, metric order by bucket) upto, sum(n) over (partition by level, lang, source, metric) total from grouped join trusted using (metric)),
q as (select level, lang, source, metric, max(total) total, min(bucket) filter (where upto * 100 >= total * coalesce(low, 0)) a, min(bucket) filter (where upto * 100 >= total * 50) b, min(bucket) filter (where upto * 100 >= total * high) c from upto group by all),
top as materialized (select level, lang, source, metric, total, unnest(list_transform([a, b, c], lambda x: case when x < 64 then x else (x - (x // 32 - 1) * 32 + 1) * (1::bigint << (x // 32 - 1)::int) - 1 end)) t, unnest(['a', 'b', 'c']) k from q),
tops as materialized (select level, lang, source, metric, max(total) total, max(t) filter (where k = 'a') a, max(t) filter (where k = 'b') b, max(t) filter (where k = 'c') c from top group by all),
fence as (select x.lang, x.source, x.metric, case when x.total >= 200 then x.a when y.total >= 200 then y.a else z.a end a, case when x.total >= 200 then x.b when y.total >= 200 then y.b else z.b end b, case when x.total >= 200 then x.c when y.total >= 200 then y.c else z.c end c
  from tops x join tops y on y.level = 1 and x.lang = y.lang and x.metric = y.metric join tops z on z.level = 2 and x.metric = z.metric where x.level = 0),
inside as (select r, bool_and(v <= c + 2.5::double * greatest(c - b, 1000 / greatest("of", 1)) and (measured.metric <> 'word_length' or v >= a - 2.5::double * greatest(b - a, 1000 / greatest("of", 1)))) ok
  from measured join fence on coalesce(measured.lang, chr(1)) = fence.lang and coalesce(measured.source, chr(1)) = fence.source and measured.metric = fence.metric group by r)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed, coalesce(ok, false) and not base_failed kept
from m left join inside using (r)""",
    "op7_warc": r"""
with p as (select page_id, coalesce(html, '') h, max(page_id) over (partition by coalesce(html, '')) o from pages),
d as (select page_id, o, strlen(h) n, array_to_string(list_transform(string_split(sha1(h), ''), lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x)]), '') bits from p)
select page_id, n::bigint payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1]::int + 8 * bits[5 * i + 2]::int + 4 * bits[5 * i + 3]::int + 2 * bits[5 * i + 4]::int + bits[5 * i + 5]::int, 1)), '') payload_digest,
  case when o = page_id then 'response' else 'revisit' end record_type, case when o <> page_id then o end refers_to
from d""",
    "op10_suffix_dedup": r"""
with t as materialized (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
win as materialized (select r, i, md5_number(substr(x, (2 * i + 1)::int, 400)) h from (select r, x, unnest(range(0, strlen(x) // 2 - 199)) i from t)),
again as materialized (select r, i from win join (select h from win group by h having count(*) > 1) using (h)),
runs as materialized (select r, min(i) a, max(i) + 200 b from (select r, i, sum(new) over (partition by r order by i) g from (select r, i, (coalesce(i - lag(i) over (partition by r order by i), 201) > 200)::int new from again)) group by r, g),
cut as (select r, sum(b - a) n, count(*) k, list(b order by a) bs, list(a order by a) xs from runs group by r)
select doc_id, (strlen(x) // 2)::bigint n_bytes, coalesce(n, 0)::bigint n_removed, coalesce(k, 0)::bigint n_spans,
  sha256(unhex(case when k is null then x else array_to_string(list_transform(range(0, k + 1), lambda i: substr(x, (2 * case when i = 0 then 0 else bs[i] end + 1)::int, (2 * (case when i = k then strlen(x) // 2 else xs[i + 1] end - case when i = 0 then 0 else bs[i] end))::int)), '') end)) kept_sha256
from t left join cut using (r)""",
    "op6_line_dedup": r"""
with lines as (
  select doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from (select doc_id, unnest(s) l, unnest(range(len(s))) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) s from documents))),
owners as (select k, min(doc_id) o from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select doc_id, i, l, coalesce(o <> doc_id, false) dropped from lines left join owners using (k))
select doc_id, count(*)::bigint n_lines, (count(*) filter (where dropped))::bigint n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (where not dropped), '')) kept_sha256
from marked group by doc_id""",
    "op9_decontamination": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, len(w) n, array_to_string(w, ' ') g from iw where len(w) between 1 and 9
  union select item_id, 10, array_to_string(w[i:i + 9], ' ') from (select item_id, w, unnest(range(1, len(w) - 8)) i from iw where len(w) >= 10)),
sizes as (select distinct n from win),
grams as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from grams join win using (n, g)),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
found as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct doc_id, cast(item_id as varchar) item_id from hits) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join covered using (doc_id) left join found using (doc_id)""",
}
