"""Every pipeline stage on nulls, empty and very long texts, repeats, clashing columns, text ids and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
KEEPERS = [name for name, _ in corpus_pipeline.STAGES[:-1]]
SMALL = "/root/testdata/sf0.001"


def clashing(odd):
    """Names that operators use themselves, and one that differs from ours by case alone."""
    extra = odd
    for name in ("anomaly", "n_card", "n_email", "_text", "row", "t", "h", "id", "key", "nth", "_own_0", "word", "perplexity"):
        extra = extra.withColumn(name, F.lit(name))
    return extra


@pytest.mark.parametrize("name", KEEPERS)
def test_columns_stay(spark, odd, name):
    docs = clashing(odd)
    out = STAGES[name](spark, docs, SMALL)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert out.where("anomaly <> 'anomaly' or row <> 'row'").isEmpty()


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_text_ids(spark, sample, name):
    docs = sample.limit(40).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    out = STAGES[name](spark, docs, SMALL)
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in out.collect()} <= ids and out.count() > 0


def test_nulls_and_repeats(spark, odd):
    toxic = STAGES["toxicity"](spark, odd, SMALL)
    assert toxic.count() == odd.count()  # nothing in it is toxic, whatever is null
    quality = STAGES["quality_rules"](spark, odd, SMALL)
    assert quality.count() == 0  # all are short or repeat themselves
    pii = STAGES["personal_data"](spark, odd, SMALL)
    assert sorted(str(r.text) for r in pii.collect()) == sorted(str(r.text) for r in odd.collect())
    packed = STAGES["packing"](spark, odd, SMALL).groupBy().agg(F.count_distinct("doc_id").alias("n"), F.sum(F.col("doc_id").isNull().cast("int")).alias("nameless")).first()
    assert packed.n == 9 and packed.nameless == 1


def test_the_whole_pipeline(spark, tmp_path, odd, some_labels):
    for n, docs in enumerate((odd, odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        some_labels.write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{n}").count() == 0
    assert corpus_pipeline.run(spark, SMALL).where("length <= 0").isEmpty()
