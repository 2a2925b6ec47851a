import pytest
from pyspark.sql import Row

LONG = "lorem ipsum dolor, sit amet! " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats, shared ids, and extra columns with names that operators use."""
    texts = [(1, "Ünï çödé 漢字 ▁ marker"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "same text here again"), (7, "same text here again"), (7, "same text here again"), (None, "no id at all"), (9, "a\x00b <|endoftext|> </s> 12 345"), (10, "x" * 70_000)]
    rows = [Row(doc_id=i, text=t, lang=None if i == 3 else "en", source="s", n_chars=len(t or ""), score=1.0, fp=5, cell="c", kept=False, ids="i", media=b"m", _key="k", n_words=9, spans="p", root=1, bad=True) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, cell string, kept boolean, ids string, media binary, _key string, n_words long, spans string, root long, bad boolean").coalesce(2)


@pytest.fixture(scope="session")
def no_documents(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (5, 0, 1, "x"), (6, 1, 0, "x"), (7, 1, None, "x"), (None, 1, 1, "x"), (8, None, None, "x"), (6, 1, 0, "x"), (99, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def sample_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
