import pytest


@pytest.fixture(autouse=True)
def small_batches(spark):
    """Rows in batches, as the queries have them."""
    from utterscope.llm.common import bounded_batches
    bounded_batches(spark, 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and blank texts, a repeated row, a very long text, and
    columns whose names clash with those of the operators."""
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, "  \n\t", None, 3), (None, "no id at all here", "x", 4),
            (5, "the same words again and again", "x", 5), (5, "the same words again and again", "x", 5),
            (6, "wörd " * 20_000, "x", None), (7, "a" * 50_000, None, 7), (-8, "🙂 日本語 <|endoftext|> ½ ² \x1c", "x", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp long")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
