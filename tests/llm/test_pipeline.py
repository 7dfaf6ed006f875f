"""The pipeline's stages, each against brute force on what its predecessor kept."""

import corpus_pipeline
import pytest
from conftest import SMALL
from llm.conftest import table
from llm.test_ops import brute_hits, brute_lines, check_packing, clashing, key, one_each, words
from pyspark.sql import functions as F

from pitlake.llm import linededup


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and gave, over the small documents and the rough ones."""
    home = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SMALL).write.parquet(f"file://{home}/{k}")
        new = spark.read.parquet(f"file://{home}/{k}")
        out.append((docs, new))
        docs = new
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def left_of(rows):
    """Documents with the lines that stay; those that lose lines and have no word left go."""
    return [(i, t if not n else kept) for (i, t), (_, _, n, kept) in zip(rows, brute_lines(rows), strict=True) if not n or words(kept)]


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "benchmark decontamination", "best-fit packing"]
    first = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(new.columns == first for _, new in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    docs, kept = stages[0]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").join(docs.where("size(split(text, '[ \\n]+')) >= 20"), "doc_id")
    left = labels.join(kept, "doc_id", "left_semi")
    good, bad = (lambda d, q: d.where(F.col("quality") == q).count()), 0
    assert good(left, 1) >= 0.97 * good(labels, 1)
    assert good(left, bad) <= 0.3 * good(labels, bad)


def test_lines(stages):
    docs, new = stages[1]
    assert key(pairs(new)) == key(left_of(pairs(docs)))
    assert new.where("n_chars <> length(text)").count() == 0


def test_near_duplicates(stages):
    docs, new = stages[2]
    assert key(pairs(new)) == key(one_each(pairs(docs)))


def test_decontamination(spark, stages):
    docs, new = stages[3]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert key(r[0] for r in pairs(new)) == key(i for i, _, n, _ in brute_hits(pairs(docs), bench) if not n)


def test_packing(stages):
    docs, new = stages[4]
    check_packing(pairs(docs), new.collect())


def test_lines_of_rough_documents(spark, rough):
    got = linededup.without_repeated_lines(clashing(table(spark, rough)))
    assert key(pairs(got)) == key(left_of(rough))


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
